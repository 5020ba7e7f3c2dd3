"""URL filtering by sorted arrays of xxhash keys.

List entries are (host, path, verdict): rules that allow or block, and listed hosts, which are blocked where no
rule fits. Their 64-bit keys are sorted into an array, with the
entries themselves beside it in the same order. The file is handed to every executor once and memory-mapped. A
batch of URLs is cut into all (host suffix, path prefix) candidates that some entry could equal by its lengths; their
keys are looked up by one vectorised binary search, and what is found is compared with the stored string, so a
colliding key decides nothing. The longest rule that fits wins.

A list of more than MAX_BYTES becomes several such files, dealt by the hash of its hosts; the driver holds one at a time, tasks map and probe
them all in one pass over the pages.

Defined cases: a null URL, or one without ://, has empty host and path and fits no entry; a URL that nothing fits is allowed; entries that repeat count once, and of
those that differ in verdict alone block wins; null entries are left out; repeated rows get repeated
results; further columns are ignored.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small_batches, table, written

#: The query's rules come first; a host that is on the block list is judged by it where no rule fits.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Hosts are listed that have one of these between dots or hyphens.
BLOCKED_TERMS = ["ads", "adult", "bets", "casino", "pills", "spam"]
BITS = {"allow": 1, "block": 2, "listed": 4}
#: Bytes of one file.
MAX_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; A-Z of the host are lower-cased."""
    if not url or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    cut = min(ends, default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest.partition("#")[0].partition("?")[0]
    return host.encode().lower().decode(), path


def array_bytes(entries: list[tuple[str, str, str]]) -> bytes:
    """A file: header, sorted keys, offsets of the strings in key order, shapes that occur, verdicts, strings."""
    import numpy as np
    import xxhash

    best: dict[bytes, int] = {}
    for host, at, verdict in entries:
        s = f"{host}{at}".encode()
        best[s] = best.get(s, 0) | BITS[verdict]
    rows = sorted((xxhash.xxh64_intdigest(s), s, v) for s, v in best.items())
    offsets = np.cumsum([0, *(len(s) for _, s, _ in rows)], dtype="<i8")
    # only candidates whose path and host have as many characters and labels as some entry are probed
    shapes = sorted({(host.count(".") + 1, len(at)) for host, at, _ in entries})
    parts = [struct.pack("<qq", len(rows), len(shapes)), np.array([k for k, _, _ in rows], "<u8").tobytes(), offsets.tobytes(), np.array(shapes, "<i8").reshape(-1, 2).tobytes()]
    return b"".join([*parts, bytes(v for _, _, v in rows), *(s for _, s, _ in rows)])


class DigestArray:
    """A mapped file of array_bytes()."""

    def __init__(self, path: str):
        import numpy as np

        self.raw = np.memmap(path, np.uint8, "r")
        n, k = struct.unpack("<qq", self.raw[:16].tobytes())
        view = lambda at, count, kind: self.raw[at : at + 8 * count].view(kind)
        self.keys, self.offsets = view(16, n, "<u8"), view(16 + 8 * n, n + 1, "<i8")
        at = 16 + 16 * n + 8
        self.shapes = [tuple(x) for x in view(at, 2 * k, "<i8").reshape(-1, 2).tolist()]
        self.verdicts = self.raw[at + 16 * k : at + 16 * k + n]
        self.strings = at + 16 * k + n

    def text(self, i: int) -> bytes:
        return self.raw[self.strings + self.offsets[i] : self.strings + self.offsets[i + 1]].tobytes()

    def find(self, wanted: list[bytes]):
        """Index of each string, or -1."""
        import numpy as np
        import xxhash

        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys) or not wanted:
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, wanted), "<u8", len(wanted))
        at = np.searchsorted(self.keys, keys, "left")
        for j in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys).tolist():
            i = int(at[j])
            while i < len(self.keys) and self.keys[i] == keys[j]:  # entries whose keys collide stand side by side
                if self.text(i) == wanted[j]:
                    out[j] = i
                    break
                i += 1
        return out


def candidates(host: str, path: str, shapes) -> list[str]:
    labels = host.split(".")
    out = []
    for n, length in shapes:
        if n <= len(labels) and length <= len(path):
            out.append(".".join(labels[-n:]) + path[:length])
    return out


_mapped: dict[str, DigestArray] = {}


def _judge(names: list[str]):
    def run(batches):
        import numpy as np

        arrays = []
        for name in names:
            if name not in _mapped:
                _mapped[name] = DigestArray(SparkFiles.get(name))
            arrays.append(_mapped[name])
        shapes = sorted({s for a in arrays for s in a.shapes})
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            rows, wanted = [], []
            for r, (host, path) in enumerate(split):
                if host:
                    for c in candidates(host, path, shapes):
                        rows.append(r)
                        wanted.append(c.encode())
            rule, verdict = [None] * len(split), [None] * len(split)
            listed = [False] * len(split)
            for array in arrays:
                found = array.find(wanted)
                for j in np.flatnonzero(found >= 0).tolist():
                    r, s, bits = rows[j], wanted[j].decode(), array.verdicts[found[j]]
                    if bits & 4:
                        listed[r] = True
                    if bits & 3 and (rule[r] is None or len(s) > len(rule[r])):
                        rule[r], verdict[r] = s, "block" if bits & 2 else "allow"
            verdict = [v or ("block" if x else "allow") for v, x in zip(verdict, listed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"]
            )

    return run


def _handed_out(spark: SparkSession, entries: list[tuple[str, str, str]]) -> str:
    import hashlib

    sc = spark.sparkContext
    name = "urls-" + hashlib.blake2b(repr(sorted(entries)).encode(), digest_size=12).hexdigest() + ".bin"
    if not any(f.endswith("/" + name) for f in sc.listFiles):  # a file of this name has these entries
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{new_path(spark, 'urls')}/{name}")
        files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        out = files.create(at)
        out.write(array_bytes(entries))
        out.close()
        sc.addFile(files.makeQualified(at).toString())
    return name


def judge(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per page: id, host, path, rule (the longest that fits, or null), verdict. entries(host, path, verdict allow, block or listed)."""
    spark = pages.sparkSession
    small_batches(spark)
    kind = pages.schema[id_col].dataType.simpleString()
    listed = entries.select("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").distinct()
    listed = written(listed, "urlentries")
    size = listed.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 17)).first()[0] or 0
    parts = 1 + int(size // max_bytes)
    names = [_handed_out(spark, [tuple(r) for r in listed.where(F.pmod(F.xxhash64("host"), F.lit(parts)) == k).collect()]) for k in range(parts)]
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")).mapInArrow(_judge(names), f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


def hosts_with_terms(pages: DataFrame, terms: list[str], url_col: str = "url") -> DataFrame:
    """(host, path, verdict): the hosts of pages with one of the terms between dots or hyphens, as listed ones."""
    host = F.translate(F.regexp_extract(url_col, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return pages.select(host.alias("host")).distinct().where(F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, terms)))).select("host", F.lit("").alias("path"), F.lit("listed").alias("verdict"))


def op6_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules.unionByName(hosts_with_terms(pages, BLOCKED_TERMS)))


_TEXT = "coalesce(url, '')"
_HOST = f"CASE WHEN contains({_TEXT}, '://') THEN translate(regexp_extract({_TEXT}, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') ELSE '' END"
_PATH = f"CASE WHEN contains({_TEXT}, '://') THEN regexp_extract({_TEXT}, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END"
OP6_SQL = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
r(rhost, rpath, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
fits AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
         FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
listed AS (SELECT DISTINCT host FROM p WHERE list_has_any(string_split_regex(host, '[.-]'), [{", ".join(f"'{t}'" for t in BLOCKED_TERMS)}]))
SELECT p.page_id, host, path, rule,
       coalesce(v, CASE WHEN EXISTS (SELECT 1 FROM listed l WHERE p.host = l.host OR ends_with(p.host, '.' || l.host)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits USING (page_id)
"""
