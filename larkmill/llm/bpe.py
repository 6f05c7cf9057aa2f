"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token the exact encoding is unique, so is its last token. An automaton over the vocabulary yields,
at each position, the tokens that are suffixes of the prefix, longest first; the one that is compatible with the stored last
token of the rest is the last token of this prefix. Following back-pointers from the end emits the ids. Two neighbouring
tokens are compatible if no merge crosses their border before either of them is complete.

Whole texts are encoded: white space never lies inside a token of this vocabulary, so chunks between white space are encoded
one by one and remembered. A table has two generations of bounded size: what is used again moves to the young one, and when that
is full the old one goes.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import KEPT, lean, light, table

VOCABULARY = "word_bpe_49k.json"

#: Entries and key length of one generation of a worker's tables: under 100 MB a worker in all, whatever the texts.
REMEMBERED, REMEMBERED_LENGTH = 150_000, 32

END = "</w>"

# Fixed values of the file format: white space of the normaliser, contractions and classes of the pre-tokeniser.
WHITE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free code point from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class Remembered:
    """A table that forgets what was not used for a generation."""

    def __init__(self, size: int = REMEMBERED):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Bpe:
    """Encoder and decoder of one vocabulary with word ends."""

    def __init__(self, spec: dict):
        import ahocorasick
        import regex

        self.vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (self.vocab[x] for x in pair)
            whole = self.vocab[pair[0] + pair[1]]
            self.rank[a, b] = rank
            self.parts.setdefault(whole, (a, b, rank))
        self.letters = byte_letters()
        self.automaton = ahocorasick.Automaton()
        for text, i in self.vocab.items():
            key = text[: -len(END)] + "\n" if text.endswith(END) else text
            if "\n" not in key[:-1]:
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        self.white = regex.compile(WHITE)
        self.pretoken = regex.compile(PRETOKEN)
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known, self.chunks = Remembered(REMEMBERED // 3), Remembered()
        self.fits: dict[int, bool] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that touch one border of a token while it is put together, each with the rank of the merge that ends it."""
        found, ends = [], float("inf")
        while True:
            found.append((token, ends))
            if token not in self.parts:
                return found
            ends = self.parts[token][2]
            token = self.parts[token][side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when both are put together side by side."""
        if len(self.fits) >= 2 * REMEMBERED:
            self.fits.clear()
        # at equal ranks the left place merges first: it spares the border if it lies left of it
        fit = self.fits[a << 32 | b] = not any((r := self.rank.get((x, y))) is not None and r < x_ends and r <= y_ends for x, x_ends in self.spine(a, 1) for y, y_ends in self.spine(b, 0))
        return fit

    def encode_pretoken(self, text: str) -> list[int]:
        """Ids of one pre-token: per-prefix last tokens, then the way back."""
        letters, fits = self.letters, self.fits
        word = "".join([letters[b] for b in text.encode()]) + "\n"
        last, sizes = [-1] * len(word), [0] * len(word)
        for end, (token, size) in self.automaton.iter(word):
            if last[end] < 0:
                before = last[end - size] if size <= end else -1
                if size > end or before >= 0 and (self.compatible(before, token) if (fit := fits.get(before << 32 | token)) is None else fit):
                    last[end], sizes[end] = token, size
        ids, at = [], len(word) - 1
        while at >= 0:
            ids.append(last[at])
            at -= sizes[at]
        ids.reverse()
        return ids

    def chunk(self, text: str) -> tuple[bytes, str]:
        """Ids (little-endian, 32 bits each) and decoded text of a chunk without white space."""
        found = self.chunks.get(text)
        if found is None:
            lowered = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            parts = self.pretoken.findall(lowered)
            if len(parts) == 1:
                ids = self.encode_pretoken(parts[0])
            else:
                ids = []
                for part in parts:
                    some = self.known.get(part)
                    if some is None:
                        some = self.encode_pretoken(part)
                        if len(part) <= REMEMBERED_LENGTH:
                            self.known.put(part, some)
                    ids += some
            found = (array("I", ids).tobytes(), self.decode(ids))
            if len(text) <= REMEMBERED_LENGTH:
                self.chunks.put(text, found)
        return found

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """Of a text: ids and decoded text, chunk by chunk."""
        if self.specials and "<|" in text:
            found = []
            for x in self.specials.split(text):
                if x in self.special:
                    found.append((self.special[x].to_bytes(4, "little"), x))
                else:
                    found += [self.chunk(y) for y in self.white.split(x) if y]
            return found
        chunks, chunk = self.chunks, self.chunk
        return [chunks.young.get(x) or chunk(x) for x in self.white.split(text) if x]

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return list(array("I", b"".join([x[0] for x in self.pieces(text)])))

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the vocabulary file names no decoder, so tokens are joined by blanks."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def loaded(content: bytes) -> Bpe:
    """The encoder of a vocabulary file, built once per worker."""
    key = hashlib.sha256(content).hexdigest()
    if KEPT.get("bpe", ("", None))[0] != key:
        KEPT["bpe"] = (key, Bpe(json.loads(content)))
    return KEPT["bpe"][1]


def read_vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file's bytes (a few MB, read on the driver)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


def encode_documents(documents: DataFrame, path: str | None = None, ids: bool = True, decoded: bool = True, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, where asked for, token_ids array<int> and decoded string; then the
    columns of keep as they are.

    Null texts count as empty, which have no tokens. Repeated rows give a row each, rows of a null id too. Other columns are not
    read; a column of keep must not have the name of a result.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(path))
    source = lean(documents).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *keep)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids + ", decoded string" * decoded
    schema = StructType([*StructType.fromDDL(schema).fields, *source.schema.fields[2:]])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bpe = loaded(shared.value)
        kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * ids + [pa.string()] * decoded
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * ids + ["decoded"] * decoded + list(keep)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, out = batch.slice(lo, 500), []
                for t in part.column(1).to_pylist():
                    found = bpe.pieces(t or "")
                    raw = b"".join([x[0] for x in found])
                    joined = " ".join([x[1] for x in found if x[1]])
                    row = [len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(joined.encode()).hexdigest()]
                    out.append(row + [np.frombuffer(raw, "<u4").astype(np.int32)] * ids + [joined] * decoded)
                made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made, *part.columns[2:]], names)

    return source.mapInArrow(light(run, "bpe"), schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of all documents."""
    return encode_documents(table(spark, sf_dir, "documents"), ids=False, decoded=False)
