"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

All new words of a batch lie in one flat numpy array of symbols. A round finds the best rank among each word's
neighbouring pairs by a segmented minimum, merges all places of that rank at once, leftmost first, and compacts
the array; words without a pair leave it. Rounds end when no pair is left. Where a merge could call for an earlier
one than the next of its rank, that word merges its leftmost place alone, so the result is that of a queue by
score and place. Decoding gathers piece bytes from one buffer by a table of offsets.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

TOKENIZER = "piece_bpe_32k.model"
#: Words whose ids a worker remembers, twice at most; the longest one that it remembers; characters of one run of rounds.
CACHE_WORDS, CACHE_LENGTH, ROUND_CHARACTERS = 80_000, 40, 1_000_000
#: Rows handed back to Spark at once: bounds what a worker holds beside the batch that it reads.
ROWS_OUT = 500
BLANK = "▁"
#: Characters that a model may keep apart from letters in all its pieces; texts are then cut between the two.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalpha())
_NEVER = np.int64(2**31)


class Encoder:
    """Ids by the vocabulary of a BPE model with byte fallback, an identity normaliser and a blank put before the text."""

    def __init__(self, model: bytes):
        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = own.get_piece_size()
        kept = [i for i in range(size) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))]
        if any(own.is_unused(i) for i in kept) or own.normalize("  a b ") != f"{BLANK * 3}a b{BLANK}":
            raise ValueError("a model with unused pieces or a normaliser isn't supported")
        pieces = {own.id_to_piece(i): i for i in kept}
        self.byte_ids = [0] * 256
        for i in range(size):
            if own.is_byte(i):
                self.byte_ids[int(own.id_to_piece(i)[3:5], 16)] = i
        #: A symbol is a piece, or else a character of some piece; what isn't a piece has a number from `size` on.
        self.symbols = pieces | {c: size + k for k, c in enumerate(sorted({c for p in pieces for c in p} - pieces.keys()))}
        self.size, self.first_free = size, size + len(self.symbols)
        scores = {i: own.get_score(i) for i in kept}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.first_free + b] = (ranks[scores[i]], i)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()] + [0], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], dtype=np.int64)
        table = np.full(0x110000, -1, dtype=np.int32)
        singles = [s for s in self.symbols if len(s) == 1]
        table[[ord(c) for c in singles]] = [self.symbols[c] for c in singles]
        self.of_code = table
        met = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}  # neighbours that a piece can hold
        self.met = np.array(sorted(self.symbols[x] * self.first_free + self.symbols[y] for x, y in met), dtype=np.int64)
        apart = all((x in _MARKS) == (y in _MARKS) for x, y in met if BLANK not in (x, y))
        marks = re.escape(_MARKS) if apart else ""
        longest = max((len(p) for p in pieces if not p.strip(BLANK)), default=0)
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        even = longest > 1 and all(self._blanks(n)[0] == longest for n in range(longest, 4 * longest))
        #: A run of blanks begins with blocks of the longest piece of blanks; a word has the blanks before it.
        block = f"{BLANK}{{{longest}}}(?={BLANK})|" if even else ""
        self.word = re.compile(f"{block}{BLANK}*[^{BLANK}\n{marks}]+|{f'{BLANK}*[{marks}]+|' if marks else ''}{BLANK}+|\n+")

    def _blanks(self, n: int) -> list[int]:
        """How many blanks each token of a run of n has."""
        ids = np.frombuffer(self._rounds([BLANK * n])[0], "<i4").tolist()
        names = {i: len(s) for s, i in self.symbols.items() if not s.strip(BLANK)}
        return [names[i] for i in ids]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, _NEVER for those that don't merge, and what it merges to."""
        wanted = left * self.first_free + right
        at = np.searchsorted(self.keys, wanted)
        hit = (left >= 0) & (right >= 0)
        hit[hit] = self.keys[np.minimum(at[hit], len(self.keys) - 1)] == wanted[hit]
        return np.where(hit, self.rank[at], _NEVER), self.merged[at]

    def _rounds(self, words: list[str]) -> list[bytes]:
        """The ids of each word, by merge rounds over all of them at once. A part is what lies between neighbours that no piece holds."""
        text = "".join(words)
        symbol = self.of_code[np.frombuffer(text.encode("utf-32-le"), "<u4")].astype(np.int64)
        lengths = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), lengths)
        pair = symbol[:-1] * self.first_free + symbol[1:]
        at = np.minimum(np.searchsorted(self.met, pair), len(self.met) - 1)
        apart = (word[1:] != word[:-1]) | (symbol[:-1] < 0) | (symbol[1:] < 0) | (self.met[at] != pair)
        part = np.append(0, np.cumsum(apart))
        place = np.arange(len(text))  # of a symbol's first character
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank, to = self._pairs(symbol[:-1], symbol[1:])
            rank = np.append(np.where(part[:-1] == part[1:], rank, _NEVER), _NEVER)
            to = np.append(to, 0)
            begins = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            lengths = np.diff(np.append(begins, len(symbol)))
            best = np.repeat(np.minimum.reduceat(rank, begins), lengths)
            if (over := best == _NEVER).any():
                done.append((part[over], place[over], symbol[over]))
                go = ~over
                symbol, place, part, rank, to, best = symbol[go], place[go], part[go], rank[go], to[go], best[go]
                if not len(symbol):
                    break
            here = rank == best
            at = np.arange(len(symbol))
            opened = np.maximum.accumulate(np.where(here & ~np.append(False, here[:-1]), at, 0))
            chosen = np.flatnonzero(here & ((at - opened) % 2 == 0))
            chosen = self._safe(symbol, part, best, to, chosen)
            symbol[chosen] = to[chosen]
            stay = np.ones(len(symbol), dtype=bool)
            stay[chosen + 1] = False
            symbol, place, part = symbol[stay], place[stay], part[stay]
        if not done:
            return []
        place, symbol = (np.concatenate(x) for x in list(zip(*done, strict=True))[1:])
        order = np.argsort(place)
        place, symbol = place[order], symbol[order]
        of_word = word[place]
        if (odd := np.flatnonzero((symbol < 0) | (symbol >= self.size))).size:
            spelt = [[self.byte_ids[b] for b in text[place[k]].encode()] for k in odd.tolist()]
            counts = np.ones(len(symbol), dtype=np.int64)
            counts[odd] = [len(s) for s in spelt]
            begin = np.cumsum(counts) - counts
            of_word, symbol = np.repeat(of_word, counts), np.repeat(symbol, counts)
            for k, s in zip(begin[odd].tolist(), spelt, strict=True):
                symbol[k : k + len(s)] = s
        ends = np.cumsum(np.bincount(of_word, minlength=len(words))) * 4
        ids = symbol.astype("<i4").tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _safe(self, symbol: np.ndarray, part: np.ndarray, best: np.ndarray, to: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """The chosen places; of a part in which one merge brings up a pair as good as the round's, the first place alone."""
        made, last = to[chosen], len(symbol) - 1
        after = np.minimum(chosen + 2, last)
        right = self._pairs(made, symbol[after])[0]
        right[(chosen + 2 > last) | (part[after] != part[chosen])] = _NEVER
        before = np.maximum(chosen - 1, 0)
        previous = symbol[before]
        joined = np.append(False, chosen[1:] - chosen[:-1] == 2)
        previous[joined] = made[np.flatnonzero(joined) - 1]
        left = self._pairs(previous, made)[0]
        left[(chosen == 0) | (part[before] != part[chosen])] = _NEVER
        clash = np.minimum(left, right) <= best[chosen]
        if not clash.any():
            return chosen
        first = np.append(True, part[chosen][1:] != part[chosen][:-1])
        return chosen[first | ~np.isin(part[chosen], part[chosen][clash])]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't remembered."""
        out: dict[str, bytes] = {}
        ends = np.cumsum([len(w) for w in words])
        begin = 0
        while begin < len(words):
            stop = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + ROUND_CHARACTERS, "right"))
            group = words[begin : max(stop, begin + 1)]
            out.update(zip(group, self._rounds(group), strict=True))
            begin += len(group)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [self.word.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new, long = {}, {}
        for words in split:
            for w in set(words):
                if w not in self.recent:
                    if (ids := self.older.get(w)) is not None:
                        self.recent[w] = ids
                    else:
                        new[w] = None
        if new:
            for w, ids in self._learn(list(new)).items():
                (self.recent if len(w) <= CACHE_LENGTH else long)[w] = ids
        known = self.recent if not long else self.recent | long
        out = [b"".join([known[w] for w in words]) for words in split]
        if len(self.recent) >= CACHE_WORDS:
            self.older, self.recent = self.recent, {}
        return out


def _one_mark_a_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


class Decoder:
    def __init__(self, model: bytes):
        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        codecs.register_error("one-mark-a-byte", _one_mark_a_byte)
        spelt = []
        for i in range(own.get_piece_size()):
            if own.is_byte(i):
                spelt.append(bytes([int(own.id_to_piece(i)[3:5], 16)]))
            elif own.is_control(i):
                spelt.append(b"")
            else:
                spelt.append((" ⁇ " if own.is_unknown(i) else own.id_to_piece(i).replace(BLANK, " ")).encode())
        self.opens = np.array([own.id_to_piece(i).startswith(BLANK) for i in range(len(spelt))])
        self.silent = np.array([own.is_control(i) for i in range(len(spelt))])
        self.buffer = np.frombuffer(b"".join(spelt), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(s) for s in spelt])])

    def decode(self, tokens: np.ndarray) -> str:
        """The pieces' text without the blank that encoding put first; bytes that are no UTF-8 give U+FFFD each."""
        tokens = tokens[~self.silent[tokens]]
        if not len(tokens):
            return ""
        start, length = self.offset[tokens], self.offset[tokens + 1] - self.offset[tokens]
        done = np.cumsum(length)
        raw = self.buffer[np.repeat(start - (done - length), length) + np.arange(done[-1])].tobytes()
        return raw[int(self.opens[tokens[0]]) :].decode("utf-8", "one-mark-a-byte")


_ready: dict[tuple[str, int], object] = {}


def _worker(kind: type, model: Broadcast):
    """One encoder or decoder for each Python worker, whatever the number of its tasks."""
    key = (kind.__name__, hash(model.value))
    if key not in _ready:
        _ready[key] = kind(model.value)
    return _ready[key]


def _model(spark: SparkSession, path: str | None) -> Broadcast:
    with open(path or public_tokenizers.path(TOKENIZER), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per row of docs: its id, n_tokens (long) and ids (array<int>), without begin or end ids.

    tokenizer: a model file on the driver. A null or empty text has no tokens. Characters that no piece has become
    their UTF-8 bytes' ids. Repeated rows give repeated results, an empty table none; other columns are not read.
    Texts are handled whole, as is each word, however long.
    """
    model = _model(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(Encoder, model)
        for batch in (b.slice(i, ROWS_OUT) for b in batches for i in range(0, b.num_rows, ROWS_OUT)):
            ids = encoder.encode_all([t or "" for t in batch.column(1).to_pylist()])
            counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            values = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), values], ["id", "n_tokens", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode_tokens(encoded: DataFrame, id_col: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """Add text, the decoded string, to rows of encode_texts. No tokens, or null ones, give an empty string."""
    model = _model(encoded.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _worker(Decoder, model)
        for batch in (b.slice(i, ROWS_OUT) for b in batches for i in range(0, b.num_rows, ROWS_OUT)):
            ids = batch.column(2)
            values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = [decoder.decode(values[a:b].astype(np.int64)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["id", "n_tokens", "ids", "text"])

    source = encoded.select(F.col(id_col).alias("id"), "n_tokens", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids array<int>, text string")
    return out.withColumnRenamed("id", id_col)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text in UTF-8)."""
    both = decode_tokens(encode_texts(read_table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
