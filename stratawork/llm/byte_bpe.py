"""Byte-level BPE over Arrow batches with the tokenizers library: encoding with
offsets, decoding with split characters.

A byte-level vocabulary is written in characters, one for each byte value. The
library sees texts in that alphabet; ids go back to bytes by the reversed table.

The usual pre-tokenizing pattern lets no token hold white space after another
character, so a token border lies before every run of white space, and a chunk
(white space and what follows up to the next white space) has the same ids in
every text. Texts are cut into chunks, chunks seen before come from a bounded
cache, and only new ones go through the library. Letters after a blank are one match
of the pattern, as are the marks behind them and a line end before them, so such
chunks are put together from these.

Null texts count as empty and give no ids. Ids are binary columns of
little-endian unsigned 32-bit numbers.
"""

from __future__ import annotations

import base64
import functools
import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from .common import column, with_arrow

#: White space as regular expressions of Unicode define it: Python's class less
#: the four separators U+001C to U+001F.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Marks of ASCII, without the apostrophe, which may begin a match with letters.
ENDINGS = ".,;:!?$%&*+-/<=>@#^|~()[]{}\\\""
#: Below it the classes of characters are the same in all versions of Unicode.
SETTLED = "\u0250"
CACHED_CHUNKS = 800_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte value: printable Latin-1 for
    itself, the rest from U+0100 on, in order of value."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in printable}
    others = (b for b in range(256) if b not in table)
    table.update({b: chr(0x100 + i) for i, b in enumerate(others)})
    return [table[b] for b in range(256)]


#: Bytes read as Latin-1 to the alphabet.
TO_ALPHABET = {b: c for b, c in enumerate(byte_alphabet())}
SPACE = TO_ALPHABET[0x20]


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary as lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank)
                for token, rank in (line.split() for line in lines if line.strip())}


def merge_of(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last merge that makes ``token``: merge its bytes by rank, lower ranks
    only, until two parts are left. None if they never become two parts."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)]
        best, at = min(found)
        if best >= rank:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def from_ranks(path: str, pattern: str) -> Tokenizer:
    """A tokenizers model with the merges that a rank file implies."""
    ranks = read_ranks(path)
    shown = {t: t.decode("latin-1").translate(TO_ALPHABET) for t in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and (pair := merge_of(token, rank, ranks)):
            merges.append((shown[pair[0]], shown[pair[1]]))
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges,
                                ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made


def from_file(path: str) -> Tokenizer:
    """A tokenizer file; the strings of special tokens are ordinary text."""
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


class Chunks(dict):
    """Ids of chunks, made when they are first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        made = self[chunk] = self.make(chunk)
        return made


class Encoder:
    """Texts to ids, with a cache of chunks."""

    def __init__(self, tokenizer: Tokenizer, limit: int = CACHED_CHUNKS):
        self.tokenizer, self.model, self.limit = tokenizer, tokenizer.model, limit
        self.known = Chunks(self._new)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks, known = CHUNK.findall(text), self.known
        if len(known) + len(chunks) > self.limit and not all(map(known.__contains__, chunks)):
            known.clear()
        return b"".join(map(known.__getitem__, chunks))

    def _new(self, chunk: str) -> bytes:
        if chunk[0] in " \n" and len(chunk) < 100 and (chunk.isascii() or max(chunk) < SETTLED):
            if not chunk[1:].isalpha():
                stem = chunk.rstrip(ENDINGS)
                if chunk[1:len(stem)].isalpha() and len(stem) < len(chunk):
                    return self.known[stem] + self.known[chunk[len(stem):]]
            elif chunk[0] == " ":
                return self._word(chunk)
            else:
                return self.known["\n"] + self._word(chunk[1:])
        return self._any(chunk)

    def _word(self, word: str) -> bytes:
        """Letters, a space before them or not: one match of the pattern, straight to
        the model."""
        shown = word.replace(" ", SPACE) if word.isascii() else word.encode().decode("latin-1").translate(TO_ALPHABET)
        found = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(found)}I", *found)

    def _any(self, chunk: str) -> bytes:
        found = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return np.array(found, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str | None = None) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(from_ranks(path, pattern) if pattern else from_file(path))


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; an id that no token has gives nothing."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(df: DataFrame, path: str, pattern: str, text: str = "text",
           ids: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text, as the ranks in ``path`` encode
    each match of ``pattern``. ``pattern`` must keep white space from following
    other characters in a match (see above). A column named ``ids`` is replaced."""
    def maker():
        enc = encoder(path, pattern)
        return lambda batch: [[enc.ids(t) for t in column(batch, text).to_pylist()]]

    return with_arrow(df, f"`{ids}` binary", maker)


def bytes_of(table: list[bytes], raw: bytes | None) -> bytes:
    if not raw:
        return b""
    return b"".join(map(table.__getitem__, np.frombuffer(raw, "<u4").tolist()))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for. Bytes, not text: one id may
    hold only part of a character, so a slice of ids need not be valid UTF-8
    (``as_text`` reads it). Null ids give no bytes."""
    def maker():
        table = token_bytes(path)
        return lambda batch: [[bytes_of(table, v) for v in column(batch, ids).to_pylist()]]

    return with_arrow(df, f"`{decoded}` binary", maker)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``decoded``: ``encode`` and ``decode`` in one pass, so
    that a task needs one worker."""
    def maker():
        enc, table = encoder(path, pattern), token_bytes(path)

        def compute(batch):
            ids = [enc.ids(t) for t in column(batch, text).to_pylist()]
            return [ids, [bytes_of(table, v) for v in ids]]
        return compute

    return with_arrow(df, "ids binary, decoded binary", maker)


def as_text(raw: bytes) -> tuple[str, int, int]:
    """A slice of decoded bytes as text, with the number of bytes at its start
    and at its end that belong to characters cut in two."""
    head = 0
    while head < min(3, len(raw)) and raw[head] & 0xC0 == 0x80:
        head += 1
    tail = 0
    for back in range(1, min(4, len(raw) - head) + 1):
        lead = raw[-back]
        if lead & 0xC0 != 0x80:
            need = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            tail = back if need > back else 0
            break
    return raw[head:len(raw) - tail].decode("utf-8", "replace"), head, tail


def offsets(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``token_start`` and ``token_end``: for each id the code points
    of the text that it covers; ids that share a character all cover it."""
    def maker():
        table = token_bytes(path)

        def one(t: str | None, raw: bytes | None) -> tuple[list[int], list[int]]:
            size = np.array([len(table[i]) for i in np.frombuffer(raw or b"", "<u4").tolist()],
                            dtype=np.int64)
            lead = (np.frombuffer((t or "").encode(), np.uint8) & 0xC0) != 0x80
            point = np.cumsum(lead) - 1
            end = np.cumsum(size)
            if not len(end):
                return [], []
            return point[end - size].tolist(), (point[end - 1] + 1).tolist()

        def compute(batch):
            pairs = [one(t, r) for t, r in zip(column(batch, text).to_pylist(),
                                               column(batch, ids).to_pylist())]
            return [[p[0] for p in pairs], [p[1] for p in pairs]]
        return compute

    return with_arrow(df, "token_start array<bigint>, token_end array<bigint>", maker)


def digests(df: DataFrame, path: str, pattern: str, text: str = "text",
            key: str = "doc_id") -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of what they decode to."""
    made = round_trip(df.select(key, text), path, pattern, text)
    return made.select(
        key, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
