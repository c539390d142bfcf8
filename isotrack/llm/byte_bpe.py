"""Byte-level BPE encoding and decoding over Arrow batches.

A rank file names tokens as bytes.  The tokenizers library wants one printable
character for each byte, and merges instead of ranks: a token's merge is the
last pair that merging its own bytes by rank arrives at.  No other pair can
make it, as what happens inside a token's bytes doesn't depend on what stands
around them; so the library gives the ids that merging by rank gives.  A piece
that is a token as a whole is taken whole.

Texts of a batch are one buffer of UTF-8.  It is cut before each space that
follows a character other than white space: no match of the pattern crosses
such a place.  The distinct stretches of a slice are encoded once, many in one
text; byte lengths of tokens say which belong to which stretch, and a gather
puts the ids of all texts together.  Byte places become code points by a running
count of first bytes, so a token that begins or ends inside a character is told.

Decoding reverses the byte table: a text's tokens are gathered as bytes, and joined
before anything is read as UTF-8, so split characters come out whole.

Defined results: null text is empty and has no tokens; strings of special tokens
are ordinary text; an id that the table lacks is an error; null ids are none;
repeated rows are encoded each; a text of any length is encoded whole, in slices,
unless it has no place to cut; other columns, whatever their names, stay; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import gathered, runs, utf8
from .common import unused

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
JOINED = 50_000  # bytes of distinct stretches that are encoded as one text
SLICE = 2_000_000  # bytes whose stretches are told apart at once
SPELLED = 500_000  # ids that are spelled out at once
ENCODED = "ids binary, ends binary, n_split long"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def printable() -> list[str]:
    """The character that stands for each byte: itself where it shows, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging the token's bytes by rank ends with before the token itself; None if it gets stuck."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(parts[i] + parts[i + 1], np.inf), i) for i in range(len(parts) - 1))
        if best == np.inf:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int], pattern: str = PATTERN) -> str:
    """The tokenizers library's description of the same encoding."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = printable()
    name = lambda token: "".join(shown[b] for b in token)
    pairs = [last_pair(t, ranks) for t in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__)]
    made = Tokenizer(models.BPE({name(t): r for t, r in ranks.items()}, [(name(a), name(b)) for a, b in filter(None, pairs)], ignore_merges=True))
    own = pattern == PATTERN  # the library's own pattern, which it matches and maps in one step
    bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=own)
    made.pre_tokenizer = bytewise if own else pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), bytewise])
    return made.to_str()


class Codec:
    """Encoder and byte table of one vocabulary, made from a tokenizer's JSON."""

    def __init__(self, described: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(described)
        byte = {c: b for b, c in enumerate(printable())}
        tokens = {i: bytes(byte[c] for c in token) for token, i in self.library.get_vocab().items()}
        self.length = np.zeros(max(tokens) + 1, np.int64)  # 0: no such id
        for i, token in tokens.items():
            self.length[i] = len(token)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)

    def distinct(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches in a row, and how many each has."""
        lengths = np.array([len(s) for s in stretches], np.int64)
        body, stops = np.frombuffer(b"".join(stretches), np.uint8), np.cumsum(lengths)
        before = np.where(lengths > 1, body[stops - np.minimum(lengths, 2)], 0)
        joined = (body[stops - lengths] == 0x20) & surely_black(body[stops - 1], before)
        order = np.argsort(~joined, kind="stable")
        texts, n = [], int(joined.sum())
        for low, high in runs(np.concatenate([[0], np.cumsum(lengths[order[:n]])]), JOINED):
            texts.append(b"".join(stretches[i] for i in order[low:high]).decode())
        texts += [stretches[i].decode() for i in order[n:]]
        ids = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        token_ends, ends = np.cumsum(self.length[ids]), np.cumsum(lengths[order])
        upto = np.searchsorted(token_ends, ends, "right")
        if len(ends) and not np.array_equal(token_ends[upto - 1], ends):
            raise ValueError("a token crosses the end of a stretch")
        begin, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        begin[order], count[order] = np.concatenate([[0], upto[:-1]]), np.diff(upto, prepend=0)
        return ids[gathered(begin, count)], count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n + 1 places where those of each begin and end."""
        body, places = utf8(texts)
        cuts = np.sort(np.concatenate([places, cut_places(body)]), kind="stable")
        cuts = cuts[np.concatenate([[True], cuts[1:] > cuts[:-1]])]
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for low, high in runs(cuts, SLICE):
            raw, at = body[cuts[low] : cuts[high]].tobytes(), (cuts[low : high + 1] - cuts[low]).tolist()
            which, stretches = pd.factorize(np.array([raw[a:b] for a, b in zip(at, at[1:])], object))
            found, count = self.distinct(list(stretches))
            first = np.cumsum(count) - count
            ids.append(found[gathered(first[which], count[which])])
            counts.append(count[which])
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), upto[np.searchsorted(cuts, places)]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens in a row."""
        if len(ids) and (int(ids.max()) >= len(self.length) or not self.length[ids].all()):
            raise ValueError("an id that the vocabulary does not have")
        return self.bytes[gathered(self.first[ids], self.length[ids])]


def surely_black(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether a character whose last byte is ``last``, after the byte ``before``, is surely no white space.

    Within ASCII that is any byte over the space.  White space outside ASCII is
    C2 85, C2 A0, E1 9A 80, E2 80 xx, E2 81 9F and E3 80 80, so a last byte whose
    neighbour before is none of C2, 9A, 80, 81 is safe.
    """
    risky = (last >= 0x80) & ((before == 0xC2) | (before == 0x9A) | (before == 0x80) | (before == 0x81))
    return (last > 0x20) & ~risky


def cut_places(body: np.ndarray) -> np.ndarray:
    """Places of spaces that follow a character which is surely no white space."""
    at = np.flatnonzero(body == 0x20)
    at = at[at > 0]
    return at[surely_black(body[at - 1], np.where(at > 1, body[at - 2], 0))]


_CODECS: dict[int, Codec] = {}


def codec(described: str) -> Codec:
    """Made once a process for each vocabulary."""
    key = zlib.crc32(described.encode())
    return _CODECS.get(key) or _CODECS.setdefault(key, Codec(described))


def packed(values: np.ndarray, places: np.ndarray, dtype: str) -> pa.Array:
    """Little-endian numbers as one binary value for each text."""
    values = np.ascontiguousarray(values, dtype)
    ends = np.ascontiguousarray(places * values.itemsize, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(ends), pa.py_buffer(values)]).cast(pa.binary())


def encode(docs: DataFrame, path: str, pattern: str = PATTERN, offsets: bool = False) -> DataFrame:
    """``docs`` with ids, n_split and, on demand, ends; names are ``encoded_columns(docs, offsets)``.

    ids and ends are little-endian unsigned 32-bit integers: tokens, and the code
    points up to each token's end, a split character counted with its first byte.
    n_split counts the tokens that begin inside a character.  The driver reads
    the rank file; tasks get it by broadcast, a vocabulary whatever the input.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(path), pattern))

    def part(own: Codec, texts: pa.Array) -> pa.StructArray:
        ids, places = own.encode(texts)
        body, begins = utf8(texts)
        later = (body & 0xC0) == 0x80  # later bytes of characters
        token_ends = np.cumsum(own.length[ids])
        inside = np.concatenate([[0], np.cumsum(later[token_ends - own.length[ids]], dtype=np.int64)])
        ends = pa.nulls(len(texts), pa.binary())
        if offsets:
            inner = np.concatenate([[0], np.cumsum(later, dtype=np.int64)])
            text = np.repeat(np.arange(len(texts)), np.diff(places))
            ends = packed(token_ends - inner[token_ends] - (begins - inner[begins])[text], places, "<u4")
        return pa.StructArray.from_arrays([packed(ids, places, "<u4"), ends, pa.array(inside[places[1:]] - inside[places[:-1]])], ["ids", "ends", "n_split"])

    def run(texts: pa.Array) -> pa.Array:
        own = codec(shipped.value)
        parts = [part(own, texts.slice(low, high - low)) for low, high in runs(utf8(texts)[1], SLICE)]
        return pa.concat_arrays(parts) if parts else part(own, texts)

    (temp,), names = unused(docs, "__encoded"), encoded_columns(docs, offsets)
    rows = docs.withColumn(temp, F.arrow_udf(run, ENCODED)("text"))
    return rows.select(*docs.columns, *[F.col(temp)[source].alias(name) for source, name in zip(("ids", "n_split", "ends"), names)])


def encoded_columns(docs: DataFrame, offsets: bool = False) -> list[str]:
    return unused(docs, "ids", "n_split", *["ends"] * offsets)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``: the bytes that the packed ids of column ``ids`` stand for."""
    shipped = rows.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(path)))

    def run(column: pa.Array) -> pa.Array:
        own = codec(shipped.value)
        values = [v or b"" for v in column.to_pylist()]
        out = []
        for low, high in runs(np.cumsum([0, *map(len, values)]), SLICE):
            pieces = [b"".join(own.spell(np.frombuffer(v, "<u4", min(SPELLED, (len(v) - at) // 4), at)).tobytes() for at in range(0, len(v), 4 * SPELLED)) for v in values[low:high]]
            out.append(pa.array(pieces, pa.binary()))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return rows.withColumn(out, F.arrow_udf(run, "binary")(ids))
