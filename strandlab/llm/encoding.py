"""Token ids of whole texts from a tokenizer file, each distinct word encoded once per worker.

A text may be cut at a place where the tokenizer always starts a new unit whatever surrounds it; then its ids
are those of its parts, one after the other.  Two kinds of file have such places:

* a tokenizer that drops white space (``blind``): at every run of ASCII white space;
* byte-level pieces (``byte``): before a single space or line feed between two characters that are not white space.

Every other file, and every text that holds the string of a special token, an unusual run of white space or (byte)
the character that marks cuts, is encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandlab.llm.shared import as_text, gather, slices

#: Bytes of text that are cut into words at once, and words that a worker remembers.
CHUNK, REMEMBERED = 6_000_000, 800_000
#: White space beyond ASCII, and controls that some engines count as such.
ODD_SPACE = r"\x{00}\x{0B}\x{0C}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SOLID = rf"[^\s{ODD_SPACE}]"
#: Letters for which composition is the identity and lower-casing does not look at neighbours.
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"
TAIL = ".,;:!?"
#: Marks the cuts of byte-level pieces; a text that holds it itself is encoded whole.
CUT = "\0"
_MARKS = np.array([chr(b) if b < 128 and chr(b) in TAIL else "" for b in range(256)], dtype=object)

_READY: dict[str, "TextEncoder"] = {}


def encoder(path: str) -> "TextEncoder":
    """The encoder of a file; one per worker process, so its memory serves all tasks of that worker."""
    if path not in _READY:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on every core already
        _READY[path] = TextEncoder(path)
    return _READY[path]


class TextEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        self.special = [t["content"] for t in form["added_tokens"]]
        self.kind = self._kind(form)
        if self.kind == "blind":
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Lowercase()
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab()
            self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.closes[[i for token, i in vocabulary.items() if token.endswith(form["model"]["end_of_word_suffix"])]] = True
        self.forget()

    @staticmethod
    def _kind(form: dict) -> str:
        if any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in form["added_tokens"]):
            return "whole"
        before, cut, model = form["normalizer"] or {}, form["pre_tokenizer"] or {}, form["model"]
        steps, cuts = [s["type"] for s in before.get("normalizers", [])], cut.get("pretokenizers", [])
        if (
            steps == ["NFC", "Replace", "Lowercase"] and before["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and before["normalizers"][1]["content"] == " "
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and r"[^\s\p{L}\p{N}]+" in cuts[0]["pattern"]["Regex"]
            and r"[\p{L}]+" in cuts[0]["pattern"]["Regex"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and model.get("end_of_word_suffix")
        ):
            return "blind"
        if not before and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]:
            return "byte"
        return "whole"

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.offsets, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts, without added special tokens; null is the empty text."""
        texts = as_text(texts)
        parts = [self._chunk(as_text(texts.slice(a, b - a))) for a, b in slices(texts, CHUNK)]
        sizes = np.concatenate([np.diff(o) for o, _ in parts]) if parts else np.zeros(0, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.concatenate([f for _, f in parts]) if parts else np.zeros(0, dtype=np.uint32)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Numbers of ids of all texts, chunk by chunk."""
        texts = as_text(texts)
        return np.concatenate([np.diff(self._chunk(as_text(texts.slice(a, b - a)), lengths=True)[0]) for a, b in slices(texts, CHUNK)] or [np.zeros(0, dtype=np.int64)])

    def _chunk(self, texts: pa.Array, lengths: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "whole":
            return self._whole(texts.to_pylist())
        whole = np.zeros(len(texts), dtype=bool)
        for name in self.special:
            whole |= np.asarray(pc.match_substring(texts, name, ignore_case=True))
        if self.kind == "byte":
            whole |= np.asarray(pc.match_substring(texts, CUT))
        lists = self._blind(texts) if self.kind == "blind" else self._byte(texts)
        begin = np.asarray(lists.offsets, dtype=np.int64)
        words = lists.flatten()
        coded = pc.dictionary_encode(words)
        codes, entries = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
        first = begin[0]
        begin = begin - first
        if self.kind == "byte":
            bad = ~np.asarray(pc.match_substring_regex(entries, rf"^[ \n]?{SOLID}([\s\S]*{SOLID})?$"))
            odd = np.zeros(len(codes) + 1, dtype=np.int64)
            np.cumsum(bad[codes], out=odd[1:])
            head = np.zeros(len(texts), dtype=bool)
            filled = begin[1:] > begin[:-1]
            head[filled] = np.asarray(pc.equal(entries, ""))[codes[begin[:-1][filled]]]
            whole |= odd[begin[1:]] - odd[begin[:-1]] > head
        offsets, flat = self._entries(entries)
        if lengths:
            size = np.concatenate([[0], np.cumsum(np.diff(offsets)[codes])])
            out = size[begin]
            flat = flat[:0]
        else:
            at, flat = gather(offsets, flat, codes)
            out = at[begin]
        return (out, flat) if not whole.any() else self._mend(texts, whole, out, flat, lengths)

    def _mend(self, texts: pa.Array, whole: np.ndarray, offsets: np.ndarray, flat: np.ndarray, lengths: bool) -> tuple[np.ndarray, np.ndarray]:
        """Put in the ids of the texts that have to be encoded whole."""
        rows = np.flatnonzero(whole)
        own, ids = self._whole(texts.take(pa.array(rows)).to_pylist())
        sizes = np.diff(offsets)
        sizes[rows] = np.diff(own)
        out = np.concatenate([[0], np.cumsum(sizes)])
        if lengths:
            return out, flat
        parts, k = [], 0
        for i, r in enumerate(rows):
            parts += [flat[offsets[k] : offsets[r]], ids[own[i] : own[i + 1]]]
            k = r + 1
        return out, np.concatenate([*parts, flat[offsets[k] :]])

    @staticmethod
    def _blind(texts: pa.Array) -> pa.Array:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        return lists

    @staticmethod
    def _byte(texts: pa.Array) -> pa.Array:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", f"{CUT} "), "\n", f"{CUT}\n")
        return pc.split_pattern(marked, CUT)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each string by the library alone."""
        found = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64), np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)

    def _entries(self, entries: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words.  A plain word with a closing mark is two units: the word and the mark."""
        if self.kind == "byte":
            code = self._units(entries)
            return gather(self.offsets, self.ids, code)
        stem = pc.replace_substring_regex(entries, f"[{TAIL}]$", "")
        plain = np.asarray(pc.match_substring_regex(stem, PLAIN))
        marked = plain & (np.asarray(pc.binary_length(stem)) < np.asarray(pc.binary_length(entries)))
        head = pc.if_else(pa.array(plain), stem, entries)
        last = np.zeros(len(entries), dtype=np.uint8)
        if marked.any():
            ends = np.frombuffer(entries.buffers()[1], dtype=np.int64)[entries.offset + 1 : entries.offset + 1 + len(entries)][marked]
            last[marked] = np.frombuffer(entries.buffers()[2], dtype=np.uint8)[ends - 1]
        tail = pa.array(_MARKS[last], pa.large_string())
        code = self._units(pa.concat_arrays([head, tail]))
        both = np.empty(2 * len(entries), dtype=np.int64)
        both[0::2], both[1::2] = code[: len(entries)], code[len(entries) :]
        at, flat = gather(self.offsets, self.ids, both)
        return at[0::2], flat

    def _units(self, units: pa.Array) -> np.ndarray:
        """Places of units in the memory; unknown ones are encoded and added."""
        if len(self.known) > REMEMBERED:
            self.forget()
        coded = pc.dictionary_encode(units)
        names = coded.dictionary
        place = pc.index_in(names, self.known)
        missing = pc.filter(names, pc.is_null(place))
        if len(missing):
            offsets, ids = self._learn(missing)
            self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
            self.ids = np.concatenate([self.ids, ids])
            known = len(self.known)
            self.known = pa.concat_arrays([self.known, missing])
            where = np.asarray(place.fill_null(-1), dtype=np.int64).copy()
            where[where < 0] = known + np.arange(len(missing))
        else:
            where = np.asarray(place, dtype=np.int64)
        return where[np.asarray(coded.indices, dtype=np.int64)]

    def _learn(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "byte":
            return self._whole(units.to_pylist())
        plain = np.asarray(pc.match_substring_regex(units, PLAIN))
        words = pc.filter(units, pa.array(plain)).to_pylist()
        joined = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        flat = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)]) if words else np.zeros(0, dtype=np.uint32)
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(words):
            return self._whole(units.to_pylist())
        own, ids = self._whole(pc.filter(units, pa.array(~plain)).to_pylist())
        sizes = np.zeros(len(units), dtype=np.int64)
        sizes[plain], sizes[~plain] = np.diff(ends, prepend=0), np.diff(own)
        order = np.empty(len(units), dtype=np.int64)
        order[plain], order[~plain] = np.arange(len(words)), len(words) + np.arange(len(units) - len(words))
        both = np.concatenate([[0], ends, len(flat) + own[1:]]).astype(np.int64)
        return gather(both, np.concatenate([flat, ids]), order)
