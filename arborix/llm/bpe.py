"""Byte-level BPE with forced boundaries.

A byte pair that occurs inside no vocabulary token is a certain cut: no merge can reach across it. A batch of texts is
one buffer of bytes, cut first where a run of letters or of other marks ends, if the pair there is such a cut: the
pre-tokeniser's pattern starts afresh at these places. Each distinct fragment is then cut by the pattern and, by a table of all
byte pairs, at the remaining certain cuts. The fragments that are left are merged independently, and a text's ids
are those of its fragments one after the other. Each task keeps what it has encoded, up to a bound and by age, so
a word is merged once for many documents. Decoding looks tokens up and joins their bytes.

Special tokens found in a text are their ids, as the tokenizers library does by default. The vocabulary
file is a parameter and must be at the same path on every executor.

Defined cases: null is the empty text, which has no ids; very long texts are cut like others; repeated rows
get repeated results; further columns are ignored.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table
from .fragments import Known, buffer, distinct, first_cuts, ragged

VOCABULARY = "byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fragments of each of the two generations that a task keeps.
CACHE = 300_000
#: Fragments that are handed to the merger at once.
PORTION = 20_000


def byte_symbols() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones as they are, others from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ForcedBoundaryBpe:
    """Encoder and decoder of one vocabulary file. Built once a Python worker."""

    def __init__(self, path: str):
        import os

        import numpy as np
        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        id_of = {bytes(symbols[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.specials}
        words = [b""] * (1 + max([*id_of.values(), *self.specials.values()]))
        for k, v in [*id_of.items(), *((k.encode(), v) for k, v in self.specials.items())]:
            words[v] = k
        self.words = words
        self.bytes_of = pa.array(words, pa.binary())
        self.text_of = pa.array([str(i) for i in range(len(words))], pa.string())
        #: joined[a, b]: some token has the bytes a and b side by side
        self.joined = np.zeros((256, 256), bool)
        for t in id_of:
            for a, b in zip(t, t[1:]):
                self.joined[a, b] = True
        self.symbol_of = {b: c for c, b in symbols.items()}
        self.pieces = regex.compile(PATTERN)
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        # the merger sees one fragment at a time: no normaliser, pre-tokeniser, special tokens or post-processor
        bare = spec | {"added_tokens": [], "truncation": None, "padding": None} | dict.fromkeys(("normalizer", "pre_tokenizer", "post_processor", "decoder"))
        self.merger = Tokenizer.from_str(json.dumps(bare))
        self.known = Known(self._learn, CACHE)

    def certain_cuts(self, pieces: list[bytes]):
        """(begins, ends) of the fragments of the joined pieces, by the table of byte pairs."""
        import numpy as np

        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.joined[data[:-1], data[1:]]
        cut[np.cumsum(sizes) - sizes] = True
        begins = np.flatnonzero(cut[:-1])
        return begins, np.append(begins[1:], len(data))

    def _learn(self, fragments: list[str]):
        """(fragment, its ids as little-endian 4-byte strings) of distinct fragments."""
        import numpy as np

        for at in range(0, len(fragments), PORTION):
            part = fragments[at : at + PORTION]
            found = [[f] if f[1:].isalpha() and (f[0] == " " or f[0].isalpha()) else self.pieces.findall(f) for f in part]
            pieces = [p.encode() for ps in found for p in ps]
            begins, ends = self.certain_cuts(pieces)
            # the last byte of each fragment tells to which one a cut belongs
            stops = np.cumsum(np.fromiter((len(f.encode()) for f in part), np.int64, len(part)))
            written = b"".join(pieces).decode("latin-1").translate(self.symbol_of)
            coded = self.merger.encode([written[a:z] for a, z in zip(begins.tolist(), ends.tolist())], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(coded.ids, "<u4")
            of = np.searchsorted(stops, begins, "right")[np.array(coded.word_ids, np.int64)] if len(ids) else np.zeros(0, np.int64)
            bounds = 4 * np.searchsorted(of, np.arange(len(part) + 1))
            data, bounds = ids.tobytes(), bounds.tolist()
            yield from ((f, data[a:z]) for f, a, z in zip(part, bounds, bounds[1:]))

    def _encode_plain(self, texts: pa.Array):
        """(ids of all texts after each other, end of each text in them); no text is null or has special tokens."""
        import numpy as np

        data, raw, offsets = buffer(texts)
        cut = first_cuts(data)
        at = np.flatnonzero(cut)
        cut[at[self.joined[data[at - 1], data[at]]]] = False  # some token has this pair
        edges, which, fragments = distinct(raw, cut, offsets)
        known = self.known.get(fragments)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, ends = ragged(np.frombuffer(b"".join(known), "<u4"), sizes, which)
        return ids, np.append(0, ends)[np.searchsorted(edges, offsets[1:])]

    def encode_batch(self, texts: pa.Array):
        """(ids of all texts after each other, end of each text in them); null is the empty text."""
        import numpy as np
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        has = pc.match_substring(texts, next(iter(self.specials))).to_numpy(zero_copy_only=False) if len(self.specials) == 1 else np.full(len(texts), bool(self.specials))
        if not has.any():
            return self._encode_plain(texts)
        parts, special, last = [], [], []
        for t, h in zip(texts.to_pylist(), has.tolist()):
            for k, p in enumerate(self.special_cut.split(t) if h else [t]):
                special.append(self.specials[p] if k % 2 else -1)
                parts.append("" if k % 2 else p)
            last.append(len(parts) - 1)
        ids, ends = self._encode_plain(pa.array(parts, pa.large_string()))
        special = np.array(special)
        at = np.flatnonzero(special >= 0)
        ids = np.insert(ids, ends[at], special[at].astype("<u4"))
        return ids, (ends + np.cumsum(special >= 0))[last]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def decoded(self, ids, ends):
        """The bytes of all texts in one buffer, and the end of each text in it."""
        import numpy as np

        out = self.bytes_of.take(pa.array(ids.astype(np.int64))).cast(pa.large_binary())
        offsets = np.frombuffer(out.buffers()[1], "<i8")[out.offset : out.offset + len(out) + 1]
        return memoryview(out.buffers()[2] or b"")[: offsets[-1]], offsets[ends]


_made: dict[str, ForcedBoundaryBpe] = {}


def encoder(path: str) -> ForcedBoundaryBpe:
    if path not in _made:
        _made[path] = ForcedBoundaryBpe(path)
    return _made[path]


def _as_text(data, begins: list[int], ends: list[int]):
    """The bytes of each text; what is not UTF-8 becomes replacement characters, as in the library."""
    try:
        str(data, "utf-8")
        plain = not any(a < z and data[a] & 0xC0 == 0x80 for a, z in zip(begins, ends))
    except UnicodeDecodeError:
        plain = False
    for a, z in zip(begins, ends):
        yield data[a:z] if plain else bytes(data[a:z]).decode("utf-8", "replace").encode()


def _encode(path: str, with_ids: bool):
    def run(batches):
        from hashlib import sha256

        import numpy as np
        import pyarrow.compute as pc

        bpe = encoder(path)
        for batch in batches:
            ids, ends = bpe.encode_batch(batch.column(1))
            offsets = pa.array(np.append(0, ends), pa.int64())
            joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets, bpe.text_of.take(pa.array(ids.astype(np.int64)))), ",")
            data, stops = bpe.decoded(ids, ends)
            stops = stops.tolist()
            columns = [
                batch.column(0),
                pa.array(np.diff(np.append(0, ends)), pa.int64()),
                pa.array([sha256(x.as_buffer() or b"").hexdigest() for x in joined]),
                pa.array([sha256(t).hexdigest() for t in _as_text(data, [0, *stops[:-1]], stops)]),
            ]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(offsets.cast(pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        _encode(path or default_path(), with_ids), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    )
    return out.withColumnRenamed("id", id_col)


def _decode(path: str):
    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of id lists."""
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(_decode(path or default_path()), f"id {kind}, text string").withColumnRenamed("id", id_col)


def op9_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
