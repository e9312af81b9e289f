"""Token alignment against the two libraries and a byte-by-byte walk."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest

public = pytest.importorskip("public_tokenizers")
PATHS = "byte_bpe_50k.json", "piece_bpe_32k.model"
EDGES = [
    None, "", " ", "  ", "a", "\n", "\n\n x", "a  b", " a", "a ", "a \n b", "a\0b", "\0", "<|endoftext|> x<|endoftext|>", "<s> </s> <unk> <0x41>", "a▁b", "▁", "ﬁ Ⅳ é ＡＢ x\ttab\r\n",
    "日本語 text", "\U0001f642\U0001f642", "x" * 3000, "one two three. " * 500, "Café déjà-vu!!", "a    b        c", "tab\tand  two",
]


@pytest.fixture(scope="module")
def paths():
    return [public.path(p) for p in PATHS]


def libraries(paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=paths[1])


def letters():
    bare = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in bare}
    for b in range(256):
        if b not in bare:
            out[chr(256 + len(out) - len(bare))] = b
    return out


def brute(texts, paths):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) by walking all pairs of tokens near each other."""
    a, b = libraries(paths)
    letter, rows, links = letters(), [], []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = f" {text or ''}".encode()
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            rows.append([0, 0, 0, 0, ""])
            links.append([])
            continue
        ends_a, ends_b = (set(np.cumsum([len(r) for r in raw]).tolist()) for raw in (raw_a, raw_b))
        stops = sorted(ends_a & ends_b)
        groups = [([], []) for _ in stops]
        spans = []
        for side, (ids, raw) in enumerate(((ids_a, raw_a), (ids_b, raw_b))):
            at = 0
            for i, r in zip(ids, raw):
                group = int(np.searchsorted(stops, at + len(r)))
                groups[group][side].append(i)
                spans.append((side, i, at, at + len(r), group))
                at += len(r)
        own = []
        members = collections.defaultdict(lambda: ([], []))
        for side, i, begin, end, group in spans:
            members[group][side].append((i, begin, end))
        for left, right in members.values():
            own += [(i, j) for i, s, e in left for j, t, f in right if s < f and t < e]
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append([len(ids_a), len(ids_b), len(groups), len(own), hashlib.sha256(line.encode()).hexdigest()])
        links.append(own)
    count = collections.Counter(p for own in links for p in own)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(*r[:4], sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), r[4]) for r, own in zip(rows, links)]


def random_texts(n, seed=5):
    random = np.random.default_rng(seed)
    parts = ["a", "B", "the", " ", " ", "  ", "\n", "\t", ".", "'s", "1", "<|endoftext|>", " ", "́", "日本", "\x00", "ß", "\r\n", "foo,", "x.", "▁", "token", "ization", "\U0001f642", "<0x0A>", "é"]
    return ["".join(parts[i] for i in random.integers(0, len(parts), int(k))) for k in random.integers(1, 30, n)]


def test_tokens_equal_libraries(paths, monkeypatch):
    from strandlab.llm import alignment

    monkeypatch.setattr(alignment, "REMEMBERED", 60)
    a, b = libraries(paths)
    one, two = alignment.ByteTokens(paths[0]), alignment.PieceTokens(paths[1])
    assert two.cuts
    texts = [t or "" for t in EDGES] + random_texts(1500)
    for k in range(0, len(texts), 97):
        part = texts[k : k + 97]
        spaced = pa.array([f" {t}" for t in part], pa.large_string())
        for (offsets, flat), want in ((one.encode(spaced), [x.ids for x in a.encode_batch([f" {t}" for t in part], add_special_tokens=False)]), (two.encode(spaced), b.encode(part))):
            assert [flat[x:y].tolist() for x, y in zip(offsets[:-1], offsets[1:])] == want


def test_terminals_of_chains():
    """Long chains of overlaps: a's tokens of two bytes from 0, b's of two bytes from 1, so that only the last ends meet."""
    from strandlab.llm.alignment import terminals

    for n in (1, 2, 7, 1000):
        end_a, end_b = np.arange(2, 2 * n + 1, 2), np.append(np.arange(1, 2 * n, 2), 2 * n)
        assert set(terminals(end_a, end_b).tolist()) == {n - 1}
    assert terminals(np.array([1, 3, 4, 6]), np.array([2, 3, 6])).tolist() == [1, 1, 3, 3, 1, 1, 3]
    assert not len(terminals(np.zeros(0, np.int64), np.zeros(0, np.int64)))


@pytest.mark.parametrize("held", [0, 40, 65_536])
def test_alignment_equals_walk(spark, paths, monkeypatch, held):
    """With no, some and all counts held by the tasks; texts longer than a block as well."""
    from strandlab.llm import alignment

    monkeypatch.setattr(alignment, "CHUNK", 500)
    texts = EDGES + random_texts(200) + ["the token"] * 30
    docs = spark.createDataFrame([(i if i % 50 else None, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, pair string, row long, best int").repartition(3)
    rows = alignment.align_corpus(docs, *paths, held).collect()
    got = sorted(tuple(r) for r in rows if r["doc_id"] is not None)
    assert got == sorted((i, *w) for i, w in enumerate(brute(texts, paths)) if i % 50)
    assert sum(r["doc_id"] is None for r in rows) == -(-len(texts) // 50)
    assert alignment.align_corpus(docs.limit(0), *paths, held).count() == 0
