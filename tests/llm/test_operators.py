"""Every operator of the corpus package against a brute-force version, on edge rows and on the given tables."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, _id long, node long, size long"
EDGES = [
    (5, None, "en", None), (1, "", "en", "b"), (2, " \t\n", None, "a"), (3, "One two three.", "en", "a"), (4, "One  two\nthree.", "en", "a"),
    (3, "One two three.", "en", "a"), (6, "Der eine und der andere. " * 400, "de", "b"), (7, "ümlaut ÉTÉ \U0001f642 x", "de", None), (8, "12 34 !!", "fr", "b"),
    (9, "<|endoftext|> a <|ENDOFTEXT|>", "en", "a"), (None, "no id", "en", "a"), (10, "a\n\nb\n\n\nc", "en", "b"), (11, "a\n\nb\n\nc", "en", "b"), (12, "w" * 5000, "en", "b"),
]
TEXT_OF = lambda r: r[1] or ""


def frame(spark, rows):
    return spark.createDataFrame([(*r[:4], len(r[1] or ""), "x", "y", 1, 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def tokenizer(name):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return public.path(name), Tokenizer.from_file(public.path(name))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name, monkeypatch):
    from strandlab.llm import encoding

    path, library = tokenizer(name)
    random = np.random.default_rng(3)
    parts = ["a", "B", "é", "É", " ", "  ", "\n", "\t", ".", "'s", "'", "1", "the", "<|endoftext|>", "\u00a0", "\u0301", "日本", "\x00", "\x1c", "ß", "Σ", "\r\n", "foo,", "x."]
    texts = ["".join(random.choice(parts, size=int(n))) for n in random.integers(0, 30, 800)] + [TEXT_OF(r) for r in EDGES]
    monkeypatch.setattr(encoding, "CHUNK", 900)
    monkeypatch.setattr(encoding, "REMEMBERED", 50)
    made = encoding.TextEncoder(path)
    column = pa.array(["cut off", *texts]).slice(1)
    offsets, flat = made.encode(column)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert made.counts(column).tolist() == [len(w) for w in want]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_keeps_nul(name):
    from strandlab.llm import encoding

    path, library = tokenizer(name)
    random = np.random.default_rng(5)
    parts = ["a", "B", "the", " ", "\n", "\x00", "\x00", ".", "日本", "<|endoftext|>"]  # by index: numpy strings drop a NUL at their end
    texts = ["a\0b", "\0", "a \0", "\0 a", "a\0\0 b", "a\n\0b c", "plain text"] + ["".join(parts[i] for i in random.integers(0, len(parts), int(n))) for n in random.integers(1, 20, 400)]
    assert sum("\0" in t for t in texts) > 200
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    made = encoding.TextEncoder(path)
    offsets, flat = made.encode(pa.array(texts))
    assert [list(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert made.counts(pa.array(texts)).tolist() == [len(w) for w in want]


def test_language_mixture(spark, edges, empty):
    from strandlab.llm.language_id import keep_identified, mixtures, fit, predict_languages
    from strandlab.llm.shared import crc_fold

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = predict_languages(docs).join(docs, "doc_id").filter("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    names, table = fit(docs, crc_fold("doc_id", 5) != 0)
    one = {lang: docs.filter(F.col("lang") == lang).filter("n_chars > 2000").first()["text"][:1500] for lang in ("en", "de")}
    share, _ = mixtures([one["en"] + " " + one["de"], one["en"]], table)
    assert min(share[0][names.index("en")], share[0][names.index("de")]) > 0.25
    assert share[1][names.index("en")] > 0.9
    rows = {(r["doc_id"], r["lang_pred"]) for r in predict_languages(edges).collect()}
    assert {(5, "und"), (1, "und"), (2, "und"), (8, "und")} <= rows
    assert predict_languages(edges).count() == len(EDGES)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in predict_languages(given_small(docs)).collect())
    assert predict_languages(empty).count() == 0 and keep_identified(empty).columns == empty.columns
    unlabelled = edges.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in predict_languages(unlabelled).collect()} == {"und"}


def given_small(docs):
    return docs.filter("doc_id < 40")


def test_field_marginals_equal_enumeration(monkeypatch):
    from strandlab.llm import toxicity

    random = np.random.default_rng(0)
    text, move, first = np.repeat([0, 1, 3, 4], [1, 6, 3, 5]), random.normal(size=(2, 2)), 0.7
    odds = random.normal(size=len(text))
    for lane in (2, 3, 64):
        monkeypatch.setattr(toxicity, "LANE", lane)
        got, pairs = toxicity.marginals(odds, text, move, first)
        for t in np.unique(text):
            own = odds[text == t]
            total, tags, steps = 0.0, np.zeros(len(own)), np.zeros((len(own), 4))
            for y in itertools.product((0, 1), repeat=len(own)):
                weight = np.exp(own @ np.array(y) + first * y[0] + sum(move[a, b] for a, b in itertools.pairwise(y)))
                total, tags = total + weight, tags + weight * np.array(y)
                for i in range(1, len(own)):
                    steps[i, 2 * y[i - 1] + y[i]] += weight
            assert np.allclose(got[text == t], tags / total) and np.allclose(pairs[text == t], steps / total)


def test_toxicity_sums_meet_on_executors(spark, monkeypatch):
    """The driver collects one array, not one a task; all rows are in it."""
    from strandlab.llm import toxicity

    got = []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: got.extend(rows := collect(df)) or rows)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    words = [np.arange(i * toxicity.FEATURES, dtype=np.uint64) for i in range(40)]
    taught = spark.createDataFrame([(i % 2, bytearray(w.tobytes())) for i, w in enumerate(words)], "toxic int, features binary").repartition(16)

    def work(hashes, text, flags):
        return np.bincount((hashes % 100).astype(np.int64).reshape(-1), np.repeat(1.0 + flags[text], toxicity.FEATURES), minlength=100)

    found = toxicity._summed(taught, work, 100)
    want = sum(np.bincount((w % 100).astype(np.int64), minlength=100) * (1.0 + i % 2) for i, w in enumerate(words))
    assert (found == want).all()
    assert sum(len(r["sums"]) for r in got) == 8 * 100
    assert (toxicity._summed(taught.limit(0), work, 100) == 0).all()


def test_toxic_documents(spark, edges, empty):
    from strandlab.llm.toxicity import score_toxicity

    random = np.random.default_rng(1)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = list(random.choice(words, size=40))
        if toxic:
            text[int(random.integers(0, 40))] = ["Zonk", "grumblix", "fnordy"][i % 3]
        rows.append((i, " ".join(text), "en", "a"))
        labels.append((i, int(toxic)))
    docs, marked = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = score_toxicity(docs, marked).join(marked, "doc_id").filter("held_out").collect()
    assert all(r["predicted"] == r["toxic"] for r in found) and len(found) > 150
    bad = next(r for r in found if r["toxic"])
    text = rows[bad["doc_id"]][1]
    assert [text[s["begin"] : s["end"]] for s in bad["spans"]] == [["Zonk", "grumblix", "fnordy"][bad["doc_id"] % 3]]
    over = score_toxicity(edges, marked).collect()
    assert len(over) == len(EDGES) and all(0 <= r["score"] <= 1 for r in over)
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in score_toxicity(edges, nothing).collect()} == {0}
    assert score_toxicity(empty, nothing).count() == 0


def test_permutation_is_one():
    from strandlab.llm.mixing import _place, permuted

    for n in (1, 2, 7, 1000):
        seed = np.full(n, 99, dtype=np.uint64)
        out = permuted(np.arange(n), np.full(n, n), seed)
        assert sorted(out) == list(range(n)) and out[_place(n - 1, n, np.uint64(99))] == n - 1


def test_mixture(spark, edges, empty, given):
    from strandlab.llm.mixing import mixed_texts, mixture

    for docs in (given, edges):
        rows = docs.select("doc_id", "text", "source").collect()
        size = collections.Counter()
        for r in rows:
            size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        target, free, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(size.values())
        while free:
            share = left / sum(weight[s] for s in free)
            over = {s for s in free if share * weight[s] > 2 * size[s]}
            for s in over or free:
                target[s] = 2.0 * size[s] if over else share * weight[s]
            left -= sum(target[s] for s in over)
            free = free - over if over else set()
        made = mixture(docs).collect()
        assert len(made) == len(rows)
        assert sorted(map(tuple, made)) == sorted(map(tuple, mixture(docs.repartition(3)).collect())) if docs is given else True
        by_target = collections.Counter()
        for r in made:
            assert r["taken"] <= 2 * r["size"]
            by_target[round(r["target"], 6)] += r["taken"]
        wanted = collections.Counter()
        for s in order:
            wanted[round(target[s], 6)] += target[s]
        assert by_target.keys() == wanted.keys()
        assert all(abs(by_target[t] - wanted[t]) <= sum(round(target[s], 6) == t for s in order) for t in wanted)
    texts = mixed_texts(given)
    assert texts.columns == given.columns
    taken = {r["doc_id"]: r["taken"] for r in mixture(given).collect()}
    words = collections.Counter()
    for r in texts.collect():
        words[r["doc_id"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    assert {d: n for d, n in words.items() if n} == {d: n for d, n in taken.items() if n}
    assert mixture(empty).count() == 0 and mixed_texts(empty).count() == 0 and mixed_texts(edges).columns == edges.columns


def test_merkle(spark, edges, empty):
    from strandlab.llm.merkle import fingerprints

    rows = sorted(((r[0] if r[0] is not None else -(1 << 63), TEXT_OF(r)) for r in EDGES))
    want = []
    for i, (_, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        want.append((len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    got = fingerprints(edges).collect()
    assert sorted((r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    by_text = {r["fingerprint"] for r in got}
    assert len(by_text) == len({t for _, t in rows})
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    same = [r for r in got if r["doc_id"] == 3]
    assert {r["near_next"] for r in same} >= {1.0} and len({r["fingerprint"] for r in same}) == 1
    assert fingerprints(empty).count() == 0


def test_merkle_ranges(spark, monkeypatch):
    from strandlab.llm import merkle

    rows = [(i * i, f"Text {i}. More of {i}!", "en", "a") for i in range(300)]
    docs = frame(spark, rows)
    one = sorted(map(tuple, merkle.fingerprints(docs).collect()))
    monkeypatch.setattr(merkle, "RANGE_ROWS", 3)
    monkeypatch.setattr(merkle, "STEP", 7)
    assert sorted(map(tuple, merkle.fingerprints(docs.repartition(5)).collect())) == one


def test_exact_groups(spark, edges, empty, monkeypatch):
    from strandlab.llm import exact_dedup

    groups = collections.defaultdict(list)
    for r in EDGES:
        groups[re.sub(r"[\x20\x09-\x0D]", "", TEXT_OF(r))].append((-len(TEXT_OF(r)), r[0] is None, r[0] or 0))
    want = sorted((str(r[0]), min(groups[k])[2] if not min(groups[k])[1] else None, len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for r in EDGES for k in [re.sub(r"[\x20\x09-\x0D]", "", TEXT_OF(r))])
    for fan, parts in ((8, 1), (2, 9)):
        monkeypatch.setattr(exact_dedup, "FAN", fan)
        got = exact_dedup.exact_groups(edges.repartition(parts)).collect()
        assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups)
    stay = exact_dedup.drop_copies(edges)
    assert stay.columns == edges.columns and stay.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_url_filter(spark):
    from strandlab.llm.host_reputation import Rule, judge_urls

    rules = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "com/de/"), Rule("allow", "com/fr/")]
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1?x", "http://example.org/en", "http://notexample.org/es/", "http://x.org", "a://b.com/de/", "http://b.com?q=/de/", "http://b.com:80/fr/#x", "http://É.com/de/x", "https://c.net/1", "x://h/a://g/"]
    pages = spark.createDataFrame([(i, u, "<p>", "h", "p") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in judge_urls(pages, rules).collect()}
    assert got == {
        0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("a.example.org", "/es/1", "example.org/es/"), 4: ("example.org", "/en", "org/"), 5: ("notexample.org", "/es/", "org/"),
        6: ("x.org", "", None), 7: ("b.com", "/de/", "com/de/"), 8: ("b.com", "", None), 9: ("b.com:80", "/fr/", None), 10: ("É.com", "/de/x", "com/de/"), 11: ("c.net", "/1", None), 12: ("h", "/a://g/", None),
    }
    assert judge_urls(pages.filter("page_id < 0"), rules).count() == 0


def test_reputation_shrinks(spark):
    from strandlab.llm.host_reputation import host_reputation

    rows = [("bad.x.com", 0)] * 40 + [("new.x.com", None)] + [("good.y.org", 1)] * 40 + [("new.y.org", None)] + [("other.x.com", 0)] * 20
    got = {r["host"]: r for r in host_reputation(spark.createDataFrame(rows, "host string, outcome int")).collect()}
    assert not got["bad.x.com"]["allowed"] and got["good.y.org"]["allowed"]
    assert got["bad.x.com"]["rate"] < got["new.x.com"]["rate"] < got["new.y.org"]["rate"] < got["good.y.org"]["rate"]


def test_token_files(spark, edges, empty, given, tmp_path):
    from strandlab.llm.token_files import read_token_files, token_digests, write_token_files

    path, library = tokenizer("word_bpe_49k.json")
    for name, docs in (("g", given.repartition(5)), ("e", edges)):
        write_token_files(docs, str(tmp_path / name), path)
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.select("doc_id", "text").collect()))
        at, want = 0, []
        for known, d, text in rows:
            ids = [*library.encode(text, add_special_tokens=False).ids, 1]
            want.append((d if known else None, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            at += len(ids)
        assert [tuple(r) for r in token_digests(read_token_files(spark, str(tmp_path / name))).orderBy("start").collect()] == want
    only = read_token_files(spark, str(tmp_path / "g")).filter("doc_id = 17")
    assert "doc_id" in only._jdf.queryExecution().executedPlan().toString() and only.count() == 1
    write_token_files(empty, str(tmp_path / "n"), path)
    assert read_token_files(spark, str(tmp_path / "n")).count() == 0


def test_packing(spark, edges, empty, given):
    from strandlab.llm.packing import pack_documents

    path, library = tokenizer("word_bpe_49k.json")
    for docs, group in ((given.repartition(3), 20_000), (edges, 2_000_000)):
        ids = collections.defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            ids[r["doc_id"]].append([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1])
        pieces = pack_documents(docs, path, group_tokens=group).collect()
        own, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for p in pieces:
            own[p["doc_id"]].append(p)
            sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        for d, lists in ids.items():
            covered = collections.Counter()
            for p in own[d]:
                fits = [x for x in lists if len(x) == p["doc_tokens"] and zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes()) == p["ids_crc32"]]
                assert fits
                covered.update(range(p["start"], p["start"] + p["length"]))
            assert covered == sum((collections.Counter(range(len(x))) for x in lists), collections.Counter())
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at == 2048 or at & (at - 1) == 0 and at < 2048
    assert pack_documents(empty, path).count() == 0


def test_placement_balances_cost():
    from strandlab.llm.packing import place

    random = np.random.default_rng(2)
    sizes = random.integers(1, 900, 400)
    rows = place(sizes, 1000)
    cost = np.bincount(rows[:, 3], rows[:, 2] + rows[:, 2] ** 2 / 1024)
    full = np.bincount(rows[:, 3], rows[:, 2]) == 1000
    assert np.bincount(rows[:, 0], rows[:, 2]).tolist() == sizes.tolist()
    assert cost[full].std() < 0.25 * cost[full].mean()


def test_token_counts(spark, edges, empty, given, tmp_path):
    from strandlab.llm.token_counts import count_tokens, read_cache

    path, library = tokenizer("byte_bpe_50k.json")
    cache = str(tmp_path / "cache")
    assert count_tokens(empty, path, cache).count() == 0
    for docs in (given, given, edges):
        want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.select("doc_id", "text").collect())
        got = count_tokens(docs, path, cache).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    stored = read_cache(spark, cache)
    texts = {r["text"] or "" for d in (given, edges) for r in d.select("text").collect()}
    assert stored.select("content").distinct().count() == len(texts)


def brute_components(rows, width, num, den):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("small, frequent", [(64, 8), (2, 10**9)])
def test_near_join(spark, monkeypatch, small, frequent):
    from strandlab.llm import near_join

    monkeypatch.setattr(near_join, "SMALL", small)
    monkeypatch.setattr(near_join, "FREQUENT", frequent)
    monkeypatch.setattr(near_join, "LEFT", 4)
    monkeypatch.setattr(near_join, "RIGHT", 8)
    random = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    passage = list(random.choice(words, 30))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (5, "a b c")]
    for base in range(6):
        text = list(random.choice(words, 60))
        for _ in range(14):
            copy = list(text)
            for at in random.integers(0, 60, int(random.integers(0, 4))):
                copy[at] = str(random.choice(words))
            rows.append((len(rows), " ".join(copy)))
            text = copy if base % 2 else text  # chains: the first and the last are no longer alike
    rows += [(len(rows) + i, " ".join([*passage, *random.choice(words, 25)])) for i in range(30)]
    docs = frame(spark, [(d, t, "en", "a") for d, t in rows])
    if small == 64:
        want = {c for _, _, c in brute_components(rows, 5, 80, 100)}
        assert {r["doc_id"] for r in near_join.keep_first(docs).collect()} == want
    else:
        assert sorted(tuple(r) for r in near_join.near_components(docs, 4, 85, 100).collect()) == brute_components(rows, 4, 85, 100)


def test_near_join_shares_large_and_small_columns(spark, monkeypatch):
    """Copies of a base text in which a passage of more than SMALL classes covers about half."""
    from strandlab.llm import near_join

    monkeypatch.setattr(near_join, "SMALL", 4)
    monkeypatch.setattr(near_join, "FREQUENT", 10**9)  # no column is known as frequent: large ones come first as well
    random = np.random.default_rng(11)
    rows = []
    for group in range(12):
        words = [f"g{group}w{i}" for i in range(400)]
        passage = list(random.choice(words, 13, replace=False))
        for _ in range(3):
            text = [*passage, *random.choice(words, 10)]
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join([*text[:-1], f"end{len(rows)}"])), (len(rows) + 2, " ".join([*text[:-2], "last", f"end{len(rows)}"]))]
        rows += [(len(rows) + i, " ".join([*passage, *random.choice(words, 10)])) for i in range(6)]
    docs = frame(spark, [(d, t, "en", "a") for d, t in rows])
    assert sorted(tuple(r) for r in near_join.near_components(docs, 4, 85, 100).collect()) == brute_components(rows, 4, 85, 100)


def test_near_join_checks_few_pairs_of_a_large_group(spark, monkeypatch):
    """One group of near copies of which many are linked by others only: their number of checked pairs stays near theirs."""
    from strandlab.llm import near_join

    monkeypatch.setattr(near_join, "SMALL", 4)
    monkeypatch.setattr(near_join, "FREQUENT", 10**9)
    checked, linked = [], near_join._linked

    def counted(pairs, *rest):
        checked.append(pairs.count())
        return linked(pairs, *rest)

    monkeypatch.setattr(near_join, "_linked", counted)
    base, rows = [f"b{i}" for i in range(160)], []
    for edits in (1, 2):  # two texts of two edits each are not alike, but each is like a text of one edit
        for d in range(20 if edits == 1 else 100):
            text = list(base)
            for k in range(edits):
                text[10 + (37 * d + 71 * k) % 140] = f"e{len(rows)}x{k}"
            rows.append((len(rows), " ".join(text)))
    docs = frame(spark, [(d, t, "en", "a") for d, t in rows])
    assert sorted(tuple(r) for r in near_join.near_components(docs, 4, 85, 100).collect()) == brute_components(rows, 4, 85, 100)
    assert sum(checked) < 20 * len(rows)


def test_near_join_edges(spark, edges, empty):
    from strandlab.llm.near_join import keep_first, near_components

    got = near_components(edges, 4, 85, 100).collect()
    assert len(got) == len(EDGES)
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4)} == {3}
    stay = keep_first(edges)
    assert stay.columns == edges.columns and sorted(str(r["doc_id"]) for r in stay.select("doc_id").collect()) == sorted(str(d) for d in {r[0] for r in EDGES} - {4, 11})
    assert near_components(empty).count() == 0 and keep_first(empty).count() == 0


def test_components(spark):
    from strandlab.llm.components import components

    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200)] + [(7, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_pipeline(spark, edges, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for start in (docs, empty):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            from strandlab.session import cut

            before, now = now, cut(stage(spark, now, FOLDER))
            if name == "packing":
                break
            assert now.columns == start.columns
            if name != "mixing":
                assert now.count() == now.join(before, "doc_id", "left_semi").count() <= before.count()
            if name == "language_id" and start is docs:
                assert now.count() >= 0.97 * docs.count()
        assert (now.count() > 0) == (start is not empty)


def test_stages_hand_on_small_batches(spark, edges, monkeypatch):
    """A stage that ends with Python work on texts is written while Arrow batches are bounded; the setting comes back."""
    import corpus_pipeline
    from strandlab import session

    def largest():
        texts = spark.range(0, 5000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 500).alias("text"))
        return max(r["n"] for r in texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect())

    before = spark.conf.get(session.BATCH_BYTES)
    assert before == session.SPARK_BYTES and largest() > 15_000_000
    seen, cut = [], session.cut
    monkeypatch.setattr(corpus_pipeline, "cut", lambda df: seen.append((spark.conf.get(session.BATCH_BYTES), largest())) or cut(df), raising=False)
    for name, stage in corpus_pipeline.STAGES:
        if name in ("language_id", "mixing", "packing"):
            stage(spark, edges, FOLDER)
    assert len(seen) == 3 and all(kept == session.TEXT_BYTES and size < 5_000_000 for kept, size in seen)
    assert spark.conf.get(session.BATCH_BYTES) == before
    monkeypatch.undo()
    spark.conf.set(session.BATCH_BYTES, "1m")
    try:
        with session.text_batches(spark):
            assert spark.conf.get(session.BATCH_BYTES) == "1m"
        assert spark.conf.get(session.BATCH_BYTES) == "1m"
    finally:
        spark.conf.unset(session.BATCH_BYTES)


def test_packed_groups_do_not_hang_on_batches(spark, given):
    from strandlab.llm.packing import pack_documents

    path, _ = tokenizer("word_bpe_49k.json")
    rows, found = given.repartition(2, "doc_id").sortWithinPartitions("doc_id").localCheckpoint(), []
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found.append(sorted(map(tuple, pack_documents(rows, path, group_tokens=5_000).collect())))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1]
