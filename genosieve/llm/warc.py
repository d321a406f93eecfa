"""WARC archives and their capture index.

Pages become WARC records (gzip members): of equal payloads the one with the largest id is the response, the others are
revisits that refer to it. The archives are read back into locally sorted runs of index entries on shared storage, and
k-way loser-tree merges order them by url key and timestamp over the whole collection: ranges of keys are merged side by
side, in passes of bounded fan-in, and the last pass streams the capture histories.

Defined results: a null payload is empty; a null url has an empty key; null ids count as the smallest; repeated rows are
captures of their own (one of them can be the response, the others revisit it); payloads of any length are one record; extra columns are
not touched; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from genosieve.llm.common import filesystem, work_dir, written

#: Payloads shorter than this are never deduplicated.
MIN_PAYLOAD = 0
#: Bytes of an archive before compression at which the next one starts.
ARCHIVE_BYTES = 64 << 20
#: Entries of a sorted run, runs merged at once, entries of a batch in a run, entries that a merged range aims at.
RUN_ENTRIES, FAN_IN, BATCH, RANGE_ENTRIES = 100_000, 64, 1024, 100_000
#: Sampled keys for a range, ranges at most, and the tasks below which merging goes on by key range.
RANGE_KEYS, MAX_RANGES, WHOLE_TASKS = 16, 5_000, 256
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = (("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()))
_SCHEMA = pa.schema(list(_FIELDS))
_DDL = "url_key string, timestamp string, page_id bigint, archive string, offset bigint, size bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query, so that captures of a site sort together."""
    m = re.match(r"[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url or "", re.S)
    if not m:
        return ""
    return ",".join(reversed(m[1].lower().removeprefix("www.").split("."))) + ")" + (m[2].lower() or "/")


def captures(pages: DataFrame, min_payload: int = MIN_PAYLOAD, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, sha1, payload_bytes, record_type, refers_to); revisits carry no payload.

    Payloads are shuffled once, one per digest, after each task has reduced its equal ones; the rest moves as narrow
    rows, whose join adaptive execution splits where one payload is on a large share of the pages.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    p = p.select("*", F.sha1(F.col("payload").cast("binary")).alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    long = p.where(F.col("payload_bytes") >= min_payload)
    heads = long.groupBy("sha1", "payload_bytes").agg(F.max(F.struct("page_id", "url", "payload")).alias("h"))
    responses = heads.select("h.*", "sha1", "payload_bytes", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    rows = long.groupBy("sha1", "payload_bytes", "page_id", "url").agg(F.count("*").alias("n"))
    tops = long.groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("of")).where("of > 1")
    again = rows.join(tops, "sha1").withColumn("n", F.col("n") - F.when(F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url")), 1).otherwise(0))
    revisits = again.where("n > 0").select("page_id", "url", F.lit(None).cast("string").alias("payload"), "sha1", "payload_bytes", F.lit("revisit").alias("record_type"), F.col("top.page_id").alias("refers_to"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).drop("copy")
    out = responses.unionByName(revisits)
    if min_payload > 0:
        short = p.where(F.col("payload_bytes") < min_payload)
        out = out.unionByName(short.select(*p.columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))
    return out


def _b32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def to_record(page_id: int | None, url: str | None, payload: str | None, sha1: str, size: int, kind: str, refers_to: int | None) -> bytes:
    """One record; a revisit's block is the HTTP header alone."""
    name = "" if page_id is None else str(page_id)
    uri = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", f"{EPOCH + timedelta(seconds=(page_id or 0) % 10**9):%Y-%m-%dT%H:%M:%SZ}"), ("WARC-Payload-Digest", f"sha1:{_b32(sha1)}")]
    headers += [("WARC-Target-URI", uri)] if url is not None else []
    if kind == "revisit":
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return _record(headers, http + (payload or "").encode() if kind == "response" else http)


def write(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the captures as archives where they lie; returns (archive, records), computed. A name appears only when
    its archive is whole."""
    folder = path or work_dir(rows.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, where = filesystem(folder)
        names, counts, sink, held = [], [], None, 0

        def close() -> None:
            sink.close()
            fs.move(f"{where}/.{names[-1]}-{context.taskAttemptId()}", f"{where}/{names[-1]}")

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if sink is None:
                    names.append(f"part-{context.partitionId():06d}-{len(names):04d}.warc.gz")
                    counts.append(0)
                    sink = fs.open_output_stream(f"{where}/.{names[-1]}-{context.taskAttemptId()}", compression=None)
                    sink.write(gzip.compress(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{names[-1]}>"), ("WARC-Date", f"{EPOCH:%Y-%m-%dT%H:%M:%SZ}"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), 1, mtime=0))
                data = to_record(*r)
                sink.write(gzip.compress(data, 4, mtime=0))
                counts[-1] += 1
                held += len(data)
                if held >= ARCHIVE_BYTES:
                    close()
                    sink, held = None, 0
        if sink is not None:
            close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names]), pa.array(counts)], names=["archive", "records"])

    cols = rows.select("page_id", "url", "payload", "sha1", "payload_bytes", "record_type", "refers_to")
    return written(cols.mapInArrow(run, "archive string, records bigint"), "archives")


def members(f) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, bytes) of every gzip member of an open file, one at a time."""
    at = base = 0
    held = b""
    while True:
        if not held:
            held = f.read(1 << 20)
            if not held:
                return
        unzip, out = zlib.decompressobj(31), []
        while True:
            out.append(unzip.decompress(held))
            if unzip.eof:
                base += len(held) - len(unzip.unused_data)
                held = unzip.unused_data
                break
            base += len(held)
            held = f.read(1 << 20)
            if not held:
                raise ValueError(f"archive is cut off after {at}")
        yield at, base - at, b"".join(out)
        at = base


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if not lines[0].startswith("WARC/") or len(block) != int(headers["content-length"]):
        raise ValueError("not a whole WARC record")
    return headers, block


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def entries(f, archive: str) -> Iterator[tuple]:
    """Index entries of an open archive; a response's digest and length are those of the payload read."""
    for offset, size, data in members(f):
        h, block = parse(data)
        if h["warc-type"] not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        length = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
        if h["warc-type"] == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != digest or len(payload) != length:
                raise ValueError(f"payload at {offset} of {archive} is damaged")
        uri = h.get("warc-target-uri")
        stamp = re.sub(r"\D", "", h["warc-date"])
        yield url_key(unquote(uri) if uri else uri), stamp, _number(h["warc-record-id"]), archive.rpartition("/")[2], offset, size, h["warc-type"], length, digest, _number(h.get("warc-refers-to"))


def _key(e: tuple) -> tuple:
    """Order of entries: url key, timestamp, id (nulls first), place."""
    return e[0], e[1], e[2] is not None, e[2] or 0, e[3], e[4]


class LoserTree:
    """Merges sorted iterators; every step replays one path of losers, log2(k) comparisons."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        k = 1
        while k < len(runs):
            k *= 2
        self.k = k
        self.heads: list[tuple | None] = [None] * k  # (key, entry), None beyond a run's end
        for i in range(len(runs)):
            self._advance(i)
        self.losers = [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def _advance(self, i: int) -> None:
        e = next(self.runs[i], None)
        self.heads[i] = None if e is None else (_key(e), e)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][1]
            self._advance(i)
            node = (i + self.k) // 2
            while node:
                if self._before(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def _batches(rows: Iterator[tuple], size: int = BATCH) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA)


def _store(uri: str, rows: Iterator[tuple]) -> int:
    """Writes a sorted run; it gets its name when it is whole."""
    fs, where = filesystem(uri)
    temporary, n = f"{where}.{TaskContext.get().taskAttemptId()}", 0
    with fs.open_output_stream(temporary) as sink, pa.ipc.new_file(sink, _SCHEMA) as out:
        for b in _batches(rows):
            out.write_batch(b)
            n += b.num_rows
    fs.move(temporary, where)
    return n


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _segment(uri: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """A run's entries from ``low`` on and before ``high``; its batches are found by halving."""
    fs, where = filesystem(uri)
    with fs.open_input_file(where) as f:
        run = pa.ipc.open_file(f)
        a, b = 0, run.num_record_batches
        if low is not None:
            while b - a > 1:
                mid = (a + b) // 2
                if _key(next(_rows(run.get_batch(mid).slice(0, 1)))) <= low:
                    a = mid
                else:
                    b = mid
        for i in range(a, run.num_record_batches):
            for e in _rows(run.get_batch(i)):
                k = _key(e)
                if high is not None and k >= high:
                    return
                if low is None or k >= low:
                    yield e


def _spread(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Partitions of consecutive keys, in order, as many as there are keys (up to 10,000)."""
    return df.repartitionByRange(max(1, min(parts, 10_000)), key).sortWithinPartitions(key)


def _lower(keys: list[tuple], rate: int) -> list[tuple]:
    """A share of 1 / ``rate`` of the keys, chosen by their hash."""
    return [k for k in keys if zlib.crc32(repr(k).encode("utf-8", "surrogatepass")) % rate == 0]


_KEY = "struct<a: string, b: string, c: boolean, d: bigint, e: string, f: bigint>"
_KEY_TYPE = pa.struct([("a", pa.string()), ("b", pa.string()), ("c", pa.bool_()), ("d", pa.int64()), ("e", pa.string()), ("f", pa.int64())])


def _structs(keys: list[tuple]) -> list[dict]:
    return [dict(zip("abcdef", k)) for k in keys]


def sort_runs(archives: DataFrame, n_archives: int, rate: int) -> tuple[str, DataFrame]:
    """Reads every archive into sorted runs; (folder, manifest of run, n, low, high, keys), computed. ``keys`` are a share
    of 1 / ``rate`` of all keys, chosen by hash."""
    folder = work_dir(archives.sparkSession, "runs")
    schema = pa.schema([("run", pa.string()), ("n", pa.int64()), ("low", _KEY_TYPE), ("high", _KEY_TYPE), ("keys", pa.list_(_KEY_TYPE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, where = filesystem(archive)
                part, name = [], re.sub(r"\W", "-", archive.rpartition("/")[2])

                def flush(k: int) -> pa.RecordBatch:
                    part.sort(key=_key)
                    uri, keys = f"{folder}/{name}-{k:04d}", [_key(e) for e in part]
                    _store(uri, iter(part))
                    columns = [[uri], [len(part)], _structs(keys[:1]), _structs(keys[-1:]), [_structs(_lower(keys, rate))]]
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

                k = 0
                with fs.open_input_stream(where, compression=None) as f:
                    for e in entries(f, archive):
                        part.append(e)
                        if len(part) == RUN_ENTRIES:
                            yield flush(k)
                            part, k = [], k + 1
                if part:
                    yield flush(k)

    made = _spread(archives.select("archive"), "archive", n_archives).mapInArrow(run, f"run string, n bigint, low {_KEY}, high {_KEY}, keys array<{_KEY}>")
    return folder, written(made, "run-manifest")


def _merge(plan: DataFrame, folder: str, name: str, parts: int, cuts: list[tuple | None] | None) -> DataFrame:
    """Every row (r, g, runs) of a plan becomes one run, cut to range ``r`` if there are cuts: (run, r), computed."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, g, uris in zip(*(c.to_pylist() for c in batch.columns)):
                lo, hi = (cuts[r], cuts[r + 1]) if cuts else (None, None)
                uri = f"{folder}/{name}-{r:05d}-{g:06d}"
                _store(uri, iter(LoserTree([_segment(u, lo, hi) for u in uris])))
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([r], pa.int64())], names=["run", "r"])

    return written(_spread(plan, "task", parts).select("r", "g", "runs").mapInArrow(merge, "run string, r bigint"), "pass")


def _plan(runs: DataFrame, groups: int) -> DataFrame:
    """runs(run, r) -> (task, r, g, runs): about as many runs in a group as a merge takes, by hash; no list of all runs
    is made anywhere."""
    g = F.pmod(F.xxhash64("run"), F.lit(groups)).alias("g")
    return runs.groupBy("r", g).agg(F.sort_array(F.collect_list("run")).alias("runs")).withColumn("task", F.col("r") * groups + F.col("g"))


def index(archives: DataFrame, fan_in: int = FAN_IN, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """All captures of the archives in order of url key, timestamp and id; partitions are consecutive key ranges.

    Many runs are first merged whole, ``fan_in`` at a time, while that keeps WHOLE_TASKS tasks busy; then by key range,
    where a range takes the runs that reach into it. Lists of runs and tasks are tables. The driver knows sampled keys:
    about RANGE_KEYS for a range, MAX_RANGES ranges at most.
    """
    spark = archives.sparkSession
    n_archives, total = archives.agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0))).first()
    if not n_archives:
        return spark.createDataFrame([], _DDL)
    ranges = max(1, min(-(-total // range_entries), MAX_RANGES))
    folder, manifest = sort_runs(archives, n_archives, max(1, total // (ranges * RANGE_KEYS)))
    count = manifest.count()
    sample = manifest.select(F.explode("keys").alias("k")).limit(4 * MAX_RANGES * RANGE_KEYS).collect()  # some RANGE_KEYS a range are there
    keys = sorted(tuple(r.k) for r in sample)
    ranges = max(1, min(ranges, len(keys)))
    cuts = [None, *(keys[i * len(keys) // ranges] for i in range(1, ranges)), None]
    inner = cuts[1:-1]
    runs, level = manifest.select("run", "low", "high"), 0
    whole = count > fan_in and -(-count // fan_in) >= WHOLE_TASKS
    while count > fan_in and (groups := -(-count // fan_in)) >= WHOLE_TASKS:
        runs = _merge(_plan(runs.select("run", F.lit(0).cast("long").alias("r")), groups), folder, f"whole-{level}", groups, None)
        count, level = runs.count(), level + 1

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = bisect.bisect_right(inner, tuple(low.values())), bisect.bisect_right(inner, tuple(high.values()))
                yield pa.RecordBatch.from_arrays([pa.array([run] * (b - a + 1)), pa.array(range(a, b + 1), pa.int64())], names=["run", "r"])

    if whole:  # a merged run reaches nearly everywhere
        runs = runs.select("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long"))).alias("r"))
    else:
        runs = runs.mapInArrow(reach, "run string, r bigint")
    split = True
    while count > fan_in:
        groups = -(-count // fan_in)
        runs = _merge(_plan(runs, groups), folder, f"range-{level}", ranges * groups, cuts if split else None)
        split, count, level = False, groups, level + 1

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, uris in zip(*(c.to_pylist() for c in batch.columns)):
                lo, hi = (cuts[r], cuts[r + 1]) if split else (None, None)
                yield from _batches(iter(LoserTree([_segment(u, lo, hi) for u in uris])))

    return _spread(_plan(runs, 1), "task", ranges).select("r", "runs").mapInArrow(last, _DDL)
