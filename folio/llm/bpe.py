"""BPE encoding and decoding of whole texts with a public merge table.

Every short piece is merged in a contiguous rank array: the part boundaries and the rank of
each adjacent pair stand in two flat lists; the smallest rank is scanned for, its boundary is
deleted and the two neighbouring ranks are refreshed, until no pair has a rank.  Pieces of
more than ``LONG_PIECE`` parts, where that scan would be quadratic, keep the same pairs in a
heap and give the same merges.

The vocabulary is read on the driver from a path and sent to the executors as a broadcast;
its size is that of the vocabulary file, whatever the input.

What is a letter, a number or white space, and how a word is composed and lower-cased, changes
with the version of Unicode, and Python's differs from that of the tokenizers library.  So the
library's own normaliser and splitter (without any vocabulary) cut words that are not plain
Latin letters, once for each distinct word that a worker remembers; ids, merges and decoding
are this module's.

Cases: a null text counts as empty and has no tokens; special tokens written in a text are
matched before normalisation and become their ids; texts of any length are encoded whole; ties
between ranks merge from the left; repeated rows are encoded each; columns named as the results
give way, all others pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import load, python_rows

#: Parts beyond which a piece is merged through a heap.
LONG_PIECE = 200
#: Words and pieces that one Python worker remembers.
WORD_CACHE, PIECE_CACHE = 150_000, 150_000

# The white space that the normaliser folds (Unicode White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Python's str.split() also splits at these, which are ordinary characters here.
NOT_WHITE = re.compile("[\x1c-\x1f]")
SPLIT_WHITE = re.compile(f"[^{WHITE}]+")
#: Words of Latin letters without marks of their own: one piece, the same in every version of Unicode.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]+")


def read_vocabulary(path: str) -> dict:
    """Ids, merge ranks, special tokens and rules of a tokenizer file, checked to be of the kind
    that this operator encodes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
        raise ValueError("this tokenizer file is not a lower-casing BPE with word ends")
    vocab = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return {
        "vocab": vocab,
        "merges": merges,
        "end": model["end_of_word_suffix"],
        "special": {x["content"]: x["id"] for x in spec["added_tokens"]},
        "rules": json.dumps({**spec, "added_tokens": [], "post_processor": None, "model": {**model, "vocab": {}, "merges": []}}),
    }


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Recent(dict):
    """A bounded memory: what was asked for lately survives when the older half is dropped."""

    def __init__(self, most: int, make):
        self.most, self.make, self.older = most, make, {}

    def __missing__(self, key):
        if (got := self.older.get(key)) is None:
            got = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


class Codec:
    """Encodes and decodes texts; one for each Python worker."""

    def __init__(self, spec: dict):
        from tokenizers import Tokenizer

        vocab, end = spec["vocab"], spec["end"]
        self.rank, self.merged = {}, []
        for a, b in spec["merges"]:
            self.rank.setdefault((vocab[a], vocab[b]), len(self.merged))
            self.merged.append(vocab[a + b])
        self.none = len(self.merged)
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        self.spelt = letters
        self.letter = {c: i for i, c in zip(self.inner, letters)}, {c: i for i, c in zip(self.final, letters)}
        self.special = spec["special"]
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        rules = Tokenizer.from_str(spec["rules"])
        self.normal, self.split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.mark = [t[:2] for t in self.special]
        self.words = Recent(WORD_CACHE, self.word)
        self.pieces = Recent(PIECE_CACHE, self.piece)

    def packed(self, ids: list[int]) -> tuple[bytes, str]:
        return array("i", ids).tobytes(), " ".join([self.token[i] for i in ids])

    def merge(self, ids: list[int]) -> list[int]:
        if len(ids) > LONG_PIECE:
            return self.merge_long(ids)
        rank, none, merged = self.rank.get, self.none, self.merged
        ids = [-1, *ids, -1]  # no pair with an end has a rank
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i] = new = merged[low]
            del ids[i + 1], ranks[i]
            ranks[i - 1] = rank((ids[i - 1], new), none)
            ranks[i] = rank((new, ids[i + 1]), none)
        return ids[1:-1]

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in n log n: a heap of (rank, position) over linked parts."""
        n, rank, merged = len(ids), self.rank.get, self.merged
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j >= n or rank((ids[i], ids[j])) != low:
                continue
            ids[i], ids[j] = merged[low], -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n and (r := rank((ids[k], ids[right[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> tuple[bytes, str]:
        """Packed ids and decoded tokens of a piece, whose letters stand for bytes."""
        inner, final = self.letter
        ids = [inner[c] for c in piece]
        ids[-1] = final[piece[-1]]
        return self.packed(self.merge(ids))

    def word(self, word: str) -> tuple[bytes, str]:
        """Packed ids and decoded tokens of what stands between white space."""
        if LATIN.fullmatch(word):
            low = word.lower()
            return self.pieces[low if low.isascii() else "".join([self.spelt[b] for b in low.encode()])]
        done = [self.pieces[p] for p, _ in self.split(self.normal(word))]
        return done[0] if len(done) == 1 else (b"".join([i for i, _ in done]), " ".join([t for _, t in done]))

    def plain(self, text: str) -> list[tuple[bytes, str]]:
        words = SPLIT_WHITE.findall(text) if NOT_WHITE.search(text) else text.split()
        known = self.words
        return [known[w] for w in words]

    def roundtrip(self, text: str | None) -> tuple[bytes, str]:
        """Ids as packed int32, and their decoding: the tokens joined by one space."""
        if not text:
            return b"", ""
        if self.specials and any(m in text for m in self.mark) and len(parts := self.specials.split(text)) > 1:
            done = [x for p in parts for x in ([self.packed([self.special[p]])] if p in self.special else self.plain(p))]
        else:
            done = self.plain(text)
        return b"".join([i for i, _ in done]), " ".join([t for _, t in done])


def encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids array<int>`` and ``decoded string`` of the column ``text``.

    Row-local: no shuffle; every other column passes through unchanged.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path))
    kept = docs.drop("token_ids", "decoded")
    names = kept.columns

    def run(pieces):
        import numpy as np

        codec = Codec(spec.value)
        for batch in pieces:
            done = [codec.roundtrip(t) for t in batch.column(names.index(text)).to_pylist()]
            sizes = np.array([0, *[len(i) // 4 for i, _ in done]], dtype=np.int32).cumsum(dtype=np.int32)
            flat = np.frombuffer(b"".join([i for i, _ in done]), dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
            decoded = pa.array([t for _, t in done], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, decoded], [*names, "token_ids", "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return python_rows(kept, run, f"{fields}, token_ids array<int>, decoded string", text=text)


def digests(encoded: DataFrame) -> DataFrame:
    """Token count and SHA-256 digests of the ids and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode_decode(load(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file()))
