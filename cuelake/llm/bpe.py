"""BPE encoding and decoding with a published word-end BPE vocabulary.

A piece is encoded by backtracking: an Aho-Corasick automaton finds every token in the piece, the
longest token is taken first, and a token may follow another only if merging the two by the
learned ranks would leave that border alone. The last token sequence that is left is what the
merges give. Decoding gathers token strings from one buffer by a table of offsets.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers, twice at most; the longest one that it remembers; pairs of the table.
CACHE_WORDS, CACHE_LENGTH, CACHE_PAIRS = 120_000, 40, 200_000
#: Rows handed back to Spark at once: bounds what a worker holds beside the batch that it reads.
ROWS_OUT = 500
#: Added to the code of a piece's last character: it carries the end of the word.
_END = 0x1000
_PIECE = regex.compile("'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\\p{L}\\p{N}]+")
#: str.split() parts at these, too; here they are symbols.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_BLANKS = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SUFFIX = "</w>"


def _byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Encoder:
    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._to_chars = dict(enumerate(_byte_characters()))
        atoms = {self._atoms(t): i for t, i in model["vocab"].items()}
        self.length = dict(zip(atoms.values(), map(len, atoms), strict=True))
        rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            left, right = model["vocab"][a], model["vocab"][b]
            whole = atoms[self._atoms(a) + self._atoms(b)]
            self.merged[left, right] = r
            if whole not in rank:
                rank[whole], parts[whole] = r, (left, right)
        self.rank, self.parts = rank, parts
        formed = set()  # a token that merging never forms, since a part of it goes elsewhere first, is none
        for t in sorted(atoms.values(), key=lambda t: rank.get(t, -1)):
            if t not in rank or (formed.issuperset(parts[t]) and self._holds(*parts[t], (rank[t], 1))):
                formed.add(t)
        self.automaton = ahocorasick.Automaton()
        for t, i in atoms.items():
            if i in formed:
                self.automaton.add_word(t, (i, len(t) - 1))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _atoms(token: str) -> str:
        """A token with its word end, if any, folded into the last character."""
        if not token.endswith(_SUFFIX) or token == _SUFFIX:
            return token
        body = token[: -len(_SUFFIX)]
        return body[:-1] + chr(ord(body[-1]) + _END)

    def _holds(self, a: int, b: int, until: tuple[float, int]) -> bool:
        """Whether no merge joins two neighbouring tokens up to a time, given as rank and side.

        Undo the merges next to the border, latest first. Whenever the pair at the border has a merge
        that would have come before the one undone last, the border doesn't hold. Merges of one rank
        go from left to right: the left token's, the border's, the right token's.
        """
        while True:
            if (r := self.merged.get((a, b))) is not None and (r, 1) < until:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until, a = (ra, 1), self.parts[a][1]
            else:
                until, b = (rb, 2), self.parts[b][0]

    def _fits(self, left: int, right: int) -> bool:
        if (known := self.compatible.get((left, right))) is None:
            if len(self.compatible) >= CACHE_PAIRS:
                self.compatible.clear()
            known = self.compatible[left, right] = self._holds(left, right, (float("inf"), 0))
        return known

    def _tokens(self, piece: str) -> list[int]:
        """The tokens of one piece, given as atoms."""
        n, length, fits = len(piece), self.length, self._fits
        starting: list[list[int]] = [[] for _ in range(n)]
        for end, (token, before) in self.automaton.iter(piece):
            starting[end - before].append(token)  # shorter ones come first
        open_, out, at = [True] * (n + 1), [], 0
        left = len(starting[0])
        lefts = []
        while at < n:
            here = starting[at]
            while left:
                left -= 1
                token = here[left]
                end = at + length[token]
                if open_[end] and (not out or fits(out[-1], token)):
                    out.append(token)
                    lefts.append(left)
                    at = end
                    left = len(starting[at]) if at < n else 0
                    break
            else:  # nothing leads on from here: go back to the token before
                open_[at] = False
                at -= length[out.pop()]
                left = lefts.pop()
        return out

    def _word(self, word: str) -> bytes:
        """The ids of a word between blanks, by its pieces."""
        if (ids := self.older.get(word)) is None:
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                ids = b"".join(self.recent.get(part) or self._word(part) for part in (word[:-1], word[-1]))
            else:
                ids = b"".join(map(self._piece, [word] if word.isalpha() else _PIECE.findall(word)))
        if len(word) <= CACHE_LENGTH:
            if len(self.recent) >= CACHE_WORDS:
                self.older, self.recent = self.recent, {}
            self.recent[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._to_chars)
        tokens = self._tokens(piece[:-1] + chr(ord(piece[-1]) + _END))
        return struct.pack(f"<{len(tokens)}I", *tokens)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self._split.split(text) if self._split else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # a capital sigma never becomes a final one
                part = part.lower()
                words = filter(None, _BLANKS.split(part)) if _SEPARATORS.search(part) else part.split()
                known, make = self.recent, self._word
                for word in words:
                    if (ids := known.get(word)) is None:
                        ids = make(word)
                        known = self.recent
                    out.append(ids)
        return b"".join(out)


class Decoder:
    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: t.encode() + b" " for t, i in vocab.items()}
        lengths = np.array([len(strings.get(i, b"")) for i in range(max(strings) + 1)], dtype=np.int64)
        self.buffer = np.frombuffer(b"".join(strings[i] for i in sorted(strings)), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(lengths)])

    def decode(self, ids: bytes) -> str:
        """The token strings, joined by blanks: this vocabulary defines no other decoder."""
        tokens = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(tokens):
            return ""
        start, length = self.offset[tokens], self.offset[tokens + 1] - self.offset[tokens]
        done = np.cumsum(length)
        places = np.repeat(start - (done - length), length) + np.arange(done[-1])
        return self.buffer[places[:-1]].tobytes().decode()


_ready: dict[tuple[str, int], object] = {}


def _worker(kind: type, definition: Broadcast):
    """One encoder or decoder for each Python worker, whatever the number of its tasks."""
    key = (kind.__name__, hash(definition.value))
    if key not in _ready:
        _ready[key] = kind(definition.value)
    return _ready[key]


def _definition(spark: SparkSession, path: str | None) -> Broadcast:
    with open(path or public_tokenizers.path(TOKENIZER), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per row of docs: its id, n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers).

    tokenizer: a file on the driver. A null or empty text has no tokens. Special tokens' strings in a text are
    special tokens. Repeated rows give repeated results; other columns are not read. Texts are handled one by
    one and whole; no piece, however long, is cut.
    """
    definition = _definition(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(Encoder, definition)
        for batch in (b.slice(i, ROWS_OUT) for b in batches for i in range(0, b.num_rows, ROWS_OUT)):
            ids = [encoder.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)


def decode_tokens(encoded: DataFrame, id_col: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """Add text, the decoded string, to rows of encode_texts. No tokens, or null ones, give an empty string."""
    definition = _definition(encoded.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _worker(Decoder, definition)
        for batch in (b.slice(i, ROWS_OUT) for b in batches for i in range(0, b.num_rows, ROWS_OUT)):
            texts = pa.array([decoder.decode(x.as_py() or b"") for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], ["id", "n_tokens", "ids", "text"])

    source = encoded.select(F.col(id_col).alias("id"), "n_tokens", "ids")
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids binary, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """decode_tokens(encode_texts(docs)) in one pass: id, n_tokens, ids, text, with one Python worker a core in place of two."""
    definition = _definition(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _worker(Encoder, definition), _worker(Decoder, definition)
        for batch in (b.slice(i, ROWS_OUT) for b in batches for i in range(0, b.num_rows, ROWS_OUT)):
            ids = [encoder.encode(t.as_py() or "") for t in batch.column(1)]
            texts = pa.array(map(decoder.decode, ids), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), texts], ["id", "n_tokens", "ids", "text"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids binary, text string")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids' bytes), decoded_sha256 (of the decoded text in UTF-8): one row per row of docs.

    A null text is an empty one: no tokens, and the digests of nothing. Repeated rows give repeated results, an empty table none.
    """
    return round_trip(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
