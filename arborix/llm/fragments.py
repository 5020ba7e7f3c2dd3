"""Cutting a batch of texts, as one buffer of bytes, into fragments that a tokeniser's pattern keeps apart."""

from __future__ import annotations

import pyarrow as pa


def _kinds():
    """Kinds of bytes: 1 a letter, 2 a digit or other mark, 3 white space or a control, 4 the apostrophe, 0 part of a longer character."""
    import numpy as np

    return np.array([0 if a > 127 else 4 if a == 39 else 1 if chr(a).isalpha() else 3 if a < 33 or a == 127 else 2 for a in range(256)], np.uint8)


def buffer(texts: pa.Array):
    """(bytes of all texts, their Arrow buffer, begin of each text and the end of the last); no text is null."""
    import numpy as np

    texts = pa.concat_arrays([texts.cast(pa.large_string())])  # one buffer that starts at 0
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.zeros(0, np.uint8), raw, offsets


def first_cuts(data):
    """Where a piece of letters, or one of other marks, ends for certain: a boolean for each byte and one more.

    A run of letters ends at any other ASCII character, one of other marks at a space, and a mark other than
    the apostrophe, which may start a contraction, or a digit ends at a letter. Letters of two bytes that start with 0xC3 are known too.
    """
    import numpy as np

    cut = np.zeros(len(data) + 1, bool)
    if len(data) < 2:
        return cut
    now = _kinds()[data]
    latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    now[1:][latin] = 1
    a, b = now[:-1], now[1:]
    cut[1:-1] = (a == 1) & (b > 1) | ((a == 2) | (a == 4)) & (data[1:] == 32) | (a == 2) & (b == 1) & (data[1:] < 128)
    return cut


def strings(values: pa.Array) -> list[str]:
    """The values as Python strings; as one string that is split, unless the mark between them is in use."""
    import pyarrow.compute as pc

    if not len(values) or pc.any(pc.match_substring(values, "\0")).as_py():
        return values.to_pylist()
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values), pa.scalar("\0", values.type))[0].as_py().split("\0")


def distinct(raw, cut, offsets, trim: str = ""):
    """(edges, number of the fragment at each edge, distinct fragments without the trim characters at their ends); texts begin at offsets."""
    import numpy as np
    import pyarrow.compute as pc

    cut[offsets] = True
    cut[-1] = True
    edges = np.flatnonzero(cut)
    if len(edges) < 2:
        return edges, np.zeros(0, np.int32), []
    parts = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype("<i8").tobytes()), raw).dictionary_encode()
    return edges, parts.indices.to_numpy(zero_copy_only=False), strings(pc.ascii_trim(parts.dictionary, trim) if trim else parts.dictionary)


def ragged(values, sizes, which):
    """Groups of values (sizes[k] of them in group k) in the order of which: (values, end of each group)."""
    import numpy as np

    n = sizes[which]
    ends = np.cumsum(n)
    begins = np.cumsum(sizes) - sizes
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begins[which] - (ends - n), n) + np.arange(total)], ends


class Known:
    """What a task has encoded, by age: when the young half is full it replaces the old one."""

    def __init__(self, learn, size: int):
        self.learn, self.size = learn, size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, keys: list) -> list:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        lacks = [i for i, v in enumerate(found) if v is None]
        if lacks:
            new = []
            for k in dict.fromkeys(map(keys.__getitem__, lacks)):
                if k in old:
                    young[k] = old[k]
                else:
                    new.append(k)
            if new:
                young.update(self.learn(new))
            for i in lacks:
                found[i] = young[keys[i]]
        return found
