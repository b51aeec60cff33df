"""Operator 4: byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The BPE encoding of a prefix is known from its last token: what comes before is the encoding of a shorter prefix. Token
t can end the encoding of a prefix exactly if the last token before it and t stay two tokens when encoded together. So
the distinct words of a batch go into a trie, visited depth-first; a node's state is its last token, found from the
states on the path above it, and the words that share a prefix share its states. Words sorted by their bytes are the
trie's depth-first order, and the path is the stack of states: nothing else is stored.

Whether two tokens stay apart is decided by undoing their merges from the latest to the first: they do unless, at some
point, the two that touch would have been merged before the next one undone was made. Answers are kept by the worker,
and forgotten between batches when there are more than ``REMEMBERED``.
"""

from __future__ import annotations

import json
import re
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cached, table

VOCABULARY, SLICE_CHARS, REMEMBERED = "byte_bpe_50k.json", 1 << 22, 1 << 20

# Text of these characters alone splits alike by the tokenizer's pattern and by the faster one below.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a tokenizer file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 as itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Byte-level BPE from a tokenizer file."""

    def __init__(self, path: str):
        spec, letters = json.load(open(path, encoding="utf-8")), byte_letters()
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.path, self.special = path, {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that change the text around them")
        self.id = {to_bytes(s): i for s, i in model["vocab"].items() if s not in self.special}
        n = max([*self.id.values(), *self.special.values()]) + 1
        self.bytes = [b""] * n
        for s, i in self.id.items():
            self.bytes[i] = s
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.sizes = list(map(len, self.bytes))
        self.rank, self.merge, self.parts = [-1] * n, {}, [None] * n
        for r, m in enumerate(model["merges"]):
            a, b = (self.id[to_bytes(x)] for x in (m.split(" ") if isinstance(m, str) else m))
            c = self.id[self.bytes[a] + self.bytes[b]]
            self.merge[a, b] = r
            if self.parts[c] is None:
                self.rank[c], self.parts[c] = r, (a, b)
        # an automaton over suffixes: a state is the longest one that begins a token; filled in as texts need it
        self.beginnings = {t[:k] for t in self.id for k in range(1, len(t) + 1)}
        self.suffix, self.number, self.next, self.ends = [b""], {b"": 0}, {}, [()]
        self.apart: dict[int, bool] = {}
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` as two tokens when they touch."""
        rank, parts, limit = self.rank, self.parts, float("inf")
        while True:
            r = self.merge.get((a, b))
            if r is not None and r < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:  # a was made last; one of its own rank to its right would have come later
                limit, a = rank[a], parts[a][1]
            else:  # the leftmost of equal merges comes first, so one across the border would have come before b
                limit, b = rank[b] + 1, parts[b][0]

    def follow(self, state: int, byte: int) -> int:
        """The state after one more byte; its tokens, longest first, are those that may end there."""
        s = self.suffix[state] + bytes((byte,))
        while s and s not in self.beginnings:
            s = s[1:]
        if s not in self.number:
            self.number[s] = len(self.suffix)
            self.suffix.append(s)
            self.ends.append(tuple((self.id[s[k:]], len(s) - k) for k in range(len(s)) if s[k:] in self.id))
        self.next[state << 8 | byte] = self.number[s]
        return self.number[s]

    def encode_words(self, words) -> dict[bytes, list[int]]:
        """Ids of each distinct word, by one pass over the trie."""
        out, before, last, at = {}, b"", [-1], [0]  # by depth: last token, and state of the automaton
        if len(self.apart) > REMEMBERED:  # both only save work; states and their tokens are bounded by the vocabulary
            self.apart.clear()
        if len(self.next) > REMEMBERED:
            self.next.clear()
        apart, follow, ends, size = self.apart, self.next, self.ends, self.sizes
        for w in sorted(words):
            n, depth, m = len(w), 0, min(len(w), len(before))
            if w[:m] == before[:m]:
                depth = m
            else:
                while w[depth] == before[depth]:
                    depth += 1
            del last[depth + 1 :], at[depth + 1 :]
            state = at[depth]
            for d in range(depth + 1, n + 1):
                key = state << 8 | w[d - 1]
                state = follow.get(key)
                if state is None:
                    state = self.follow(key >> 8, key & 255)
                for t, k in ends[state]:
                    if k == d:
                        break
                    pair = last[d - k] << 20 | t
                    ok = apart.get(pair)
                    if ok is None:
                        ok = apart[pair] = self.stay_apart(last[d - k], t)
                    if ok:
                        break
                last.append(t)
                at.append(state)
            found, d = [], n
            while d:
                t = last[d]
                found.append(t)
                d -= size[t]
            found.reverse()
            out[w] = found
            before = w
        return out

    def words(self, text: str) -> list[str]:
        """The pieces of ``text`` that are encoded by themselves."""
        if not _OTHER.search(text):
            return _WORDS.findall(text)
        pre = cached(("pre_tokenizer", self.path), lambda: _tokenizer(self.path).pre_tokenizer)
        return [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """``words`` of the stretches between special tokens, and these."""
        if self.split_special is None or not self.split_special.search(text):
            return self.words(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [*self.words(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.words(text[at:])

    def encode_batch(self, texts: list[str]):
        """(all ids as one array of 32-bit integers, number of ids of each text)."""
        import numpy as np

        pack = lambda x: array("i", x).tobytes()
        split = [self.split(t) for t in texts]
        distinct = {w.encode(): w for w in {w for ws in split for w in ws} if w not in self.special}
        ids = {distinct[b]: pack(x) for b, x in self.encode_words(distinct).items()}
        ids |= {w: pack([i]) for w, i in self.special.items()}
        found = [b"".join(map(ids.__getitem__, ws)) for ws in split]
        return np.frombuffer(b"".join(found), np.int32), np.array([len(f) // 4 for f in found], np.int64)

    def decode_batch(self, flat, counts) -> list[str]:
        """Texts of consecutive runs of ``flat``; bytes that are no UTF-8 become replacement characters."""
        import numpy as np

        size = cached(("sizes", self.path), lambda: np.array(list(map(len, self.bytes)), np.int64))
        data = b"".join(map(self.bytes.__getitem__, flat.tolist()))
        at = np.r_[0, np.cumsum(size[flat])][np.r_[0, np.cumsum(counts)]].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoder(path: str) -> Encoder:
    return cached(("encoder", path), lambda: Encoder(path))


def slices(lengths: list[int], limit: int = SLICE_CHARS):
    """Ranges of consecutive rows of about ``limit`` characters at most, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total + n > limit and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def lengths_of(texts) -> list[int]:
    """Characters of each text of an Arrow array, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.utf8_length(texts), 0).to_pylist()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each row of ``docs``; a null text is the empty one, which has no ids."""
    path = path or vocabulary()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = encoder(path)
        for b in batches:
            rows = b.column("text")
            for s, e in slices(lengths_of(rows)):
                flat, counts = own.encode_batch([t or "" for t in rows.slice(s, e - s).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s, e - s), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded ``text``; null ids are none. Ids outside the vocabulary are an error."""
    path = path or vocabulary()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = encoder(path)
        for b in batches:
            col = b.column("ids").fill_null([]) if b.column("ids").null_count else b.column("ids")
            counts = np.diff(col.offsets.to_numpy())
            text = own.decode_batch(col.flatten().to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(text, pa.large_string()).cast(pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): ``decode(encode(docs))`` in one pass of one Python worker a task."""
    path = path or vocabulary()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = encoder(path)
        for b in batches:
            rows = b.column("text")
            for s, e in slices(lengths_of(rows)):
                flat, counts = own.encode_batch([t or "" for t in rows.slice(s, e - s).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat))
                text = pa.array(own.decode_batch(flat, counts), pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s, e - s), lists, text], ["doc_id", "ids", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, SHA-256 of its ids and of the text decoded from them."""
    both = round_trip(docs, path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
