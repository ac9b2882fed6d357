"""WARC archives written from pages and read back by boundary-chain verification.

Archives are plain WARC/1.0 text written by Spark, so each partition is a file of complete records. Reading splits
files anywhere: every occurrence of the record magic is a candidate, whose header says where its successor starts.
Chains are shortened within each split by pointer jumping; the entries of all splits are then joined by pointer
jumping from the file start. Only candidates on the chain are records; magic inside payloads is none.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rhopool.llm.filters import Filter
from rhopool.llm.store import store
from rhopool.llm.words import chain, span_hashes
from rhopool.session import checkpoint_root

MAGIC = "WARC/1.0\r\n"
SMALLEST_SHARED = 1000   # bytes from which equal payloads are revisits
GAP = 4                  # line ends after a record's block

RECORD = ("page_id bigint, uri string, record_type string, refers_to bigint, payload_bytes bigint, declared_digest string, payload_digest string")


def _uri(url: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "")


def write_archives(pages: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Writes a record for each row of ``pages(page_id, url, html)`` into WARC files below ``path``.

    The payload is the html in UTF-8 (null: empty), after the HTTP head in the record's block. Of records with equal
    payloads of at least 1000 bytes the one with the largest page_id is the response and the others revisit it: their
    block is the head alone. Rows without page_id are responses without an id, and so is each further row of a
    repeated page_id with the largest number. Other columns are ignored.

    Which rows are revisits is decided without their html. Filters of at most 64 MiB then tell most responses from
    revisits where they are read; only the html of rows that two filters leave open (a few in a hundred) meets the list.
    """
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), _uri(F.col("url")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"size": F.octet_length("html").cast("bigint"), "sha": F.sha1(F.col("html").cast("binary"))})
    shared = (own.where((F.col("size") >= SMALLEST_SHARED) & F.col("page_id").isNotNull()).groupBy("sha", "size")
              .agg(F.max("page_id").alias("original"), F.count("*").alias("times")).where("times > 1").select("sha", "size", "original"))
    # Rows of one payload may be very many, so the payload's largest number is joined to them rather than gathered.
    decided = store(own.drop("html").join(shared, ["sha", "size"], "left").withColumns(
        {"revisit": F.coalesce(F.col("page_id") < F.col("original"), F.lit(False)), "key": F.xxhash64("page_id", "sha", "size")}), "decided")
    revisits = decided.where("revisit")
    gone = Filter.of(revisits.select("key"), revisits.count())
    alike = store(decided.where("not revisit").select("key").mapInArrow(_passing(spark.sparkContext.broadcast(gone)), "key bigint"), "alike")
    shared_filters = spark.sparkContext.broadcast((gone, Filter.of(alike, alike.count())))
    own = own.withColumn("key", F.xxhash64("page_id", "sha", "size"))
    kept = own.mapInArrow(_sorted_out(shared_filters), T.StructType([*own.schema.fields, T.StructField("open", T.BooleanType())]))
    sure = kept.where("not open").drop("key", "open")
    checked = kept.where("open").join(revisits.select("page_id", "sha", "size").distinct(), ["page_id", "sha", "size"], "left_anti").select(sure.columns)
    for rows, revisit in ((sure, False), (checked, False), (revisits, True)):
        # The writer ends each value with one line feed, the last of the four bytes after a block.
        rows.select(_record(rows, revisit).alias("value")).write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def _record(rows: DataFrame, revisit: bool) -> Column:
    """The text of a record, short of its last byte."""
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = head if revisit else F.concat(head, F.col("html"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    refers = F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("original"))) if revisit else F.lit("")
    fields = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.lit("revisit" if revisit else "response"), F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), F.col("sha"), refers,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(fields, block, F.lit("\r\n\r"))


def _passing(shared):
    """The keys that a filter lets through."""

    def run(batches):
        for rows in batches:
            keys = rows.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys[shared.value(keys.view(np.uint64))])], ["key"])

    return run


def _sorted_out(shared):
    """Rows without those that are certainly revisits; ``open`` where neither filter decides."""

    def run(batches):
        gone, alike = shared.value
        for rows in batches:
            keys = rows.column("key").to_numpy().view(np.uint64)
            maybe = gone(keys)
            stay = ~maybe | alike(keys)
            rows = rows.append_column("open", pa.array(maybe))
            yield rows if stay.all() else rows.filter(pa.array(stay))

    return run


def scan(spark: SparkSession, path: str) -> DataFrame:
    """file, split, rest: the bytes from one occurrence of the magic to the next (or the file's start to the first)."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("rest"))


def _header(rest: bytes) -> tuple[dict, int]:
    """Header fields of a candidate by lower-case name, and the bytes up to its block; ({}, 0) if it has no proper end."""
    stop = rest.find(b"\r\n\r\n")
    if stop < 0:
        return {}, 0
    fields = {}
    for line in rest[:stop].split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields, stop + 4


def _number(text: str | None) -> int:
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 16 else -1


def _id(text: str | None):
    n = (text or "").removeprefix("<urn:page:").removesuffix(">")
    if not (n.removeprefix("-").isdigit() and n.isascii() and len(n) <= 20):
        return None
    return int(n) if -1 << 63 <= int(n) < 1 << 63 else None


def parse(rest: bytes) -> tuple:
    """The columns of RECORD of a complete record (without its magic and the gap after it)."""
    fields, at = _header(rest)
    block = rest[at:]
    stop = block.find(b"\r\n\r\n")
    payload = block[stop + 4:] if stop >= 0 else block
    kind = fields.get("warc-type", "")
    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None
    if kind == "revisit":
        lengths = [x.partition(b":")[2] for x in block[:max(stop, 0)].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, digest = _number(lengths[0].strip().decode("latin-1")) if lengths else 0, declared
    return _id(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, _id(fields.get("warc-refers-to")), size, declared, digest


def _candidates(batches):
    """Walks each split in order. Places are counted from the split's first row, whose own place in the file is found later.

    A row is a candidate's header and block up to the next magic. ``next`` is where the header says the successor
    starts; a row that ends there is ``whole`` and comes parsed. The first row of a file is what precedes the first magic.
    """
    key, at = None, 0
    for rows in batches:
        out = []
        for file, split, rest in zip(rows.column("file").to_pylist(), rows.column("split").to_pylist(), rows.column("rest").to_pylist()):
            if (file, split) != key:
                key, at = (file, split), 0
            fields, skip = _header(rest)
            length = _number(fields.get("content-length"))
            end = at + len(rest) + len(MAGIC)                       # where the next magic ends
            follow = at + skip + length + GAP + len(MAGIC) if length >= 0 else -1
            whole = follow == end
            out.append((file, split, at, end, follow, whole, *(parse(rest[:len(rest) - GAP]) if whole else (None,) * 7)))
            at = end
        columns = list(zip(*out)) if out else [()] * 13
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CANDIDATE_TYPES)], _CANDIDATE_NAMES)


_CANDIDATE = "file string, split bigint, at bigint, end bigint, next bigint, whole boolean, " + RECORD
_CANDIDATE_NAMES = [x.split()[0] for x in _CANDIDATE.split(", ")]
_CANDIDATE_TYPES = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in _CANDIDATE.split(", ")]


def _shorten(table):
    """Pointer jumping within a split: for each candidate the place at which its chain leaves the split (-1: it breaks off)."""
    at, follow = table.column("place").to_numpy(), table.column("follow").to_numpy()
    order = np.argsort(at)
    at, follow = at[order], follow[order]
    spot = np.searchsorted(at, follow).clip(max=len(at) - 1)
    here = (at[spot] == follow) & (follow > at)
    jump = np.where(here, spot, np.arange(len(at)))
    while True:
        twice = jump[jump]
        if np.array_equal(twice, jump):
            break
        jump = twice
    last = follow[jump]
    inside = (last >= at[0]) & (last <= at[-1])
    return pa.table({"file": table.column("file").take(pa.array(order)), "place": pa.array(at), "exit": pa.array(np.where(inside, -1, last))})


def _walk(table):
    """The candidates of a split that lie on the chain from its entry."""
    place, follow, entry = (table.column(c).to_numpy() for c in ("place", "follow", "entry"))
    to = dict(zip(place.tolist(), follow.tolist()))
    on, now = [], int(entry[0])
    while now in to:
        on.append(now)
        now = to[now] if to[now] > now else -1
    return pa.table({"file": table.column("file").take(pa.array(np.zeros(len(on), np.int64))), "place": pa.array(on, pa.int64()), "follow": pa.array([to[x] for x in on], pa.int64())})


def _entries(exits: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, place) of the candidates at which the chain from each file's start enters a split, by pointer jumping.

    After r rounds the places within 2**r hops are known and every pointer leaps 2**r hops.
    """
    reached, jump = store(starts, "reached"), exits
    before = -1
    while (now := reached.count()) != before:
        before = now
        reached = store(reached.unionAll(reached.join(jump, ["file", "place"]).select("file", F.col("exit").alias("place"))).distinct(), "reached")
        jump = store(jump.join(jump.select("file", F.col("place").alias("exit"), F.col("exit").alias("further")), ["file", "exit"]).select("file", "place", F.col("further").alias("exit")), "jumps")
    return reached


def _reassembled(table):
    """A record whose payload holds magic, from its rows in order."""
    order = np.argsort(table.column("place").to_numpy())
    rest = table.column("rest").take(pa.array(order)).to_pylist()
    whole = MAGIC.encode().join(rest)
    first, follow = int(table.column("place").to_numpy().min()), table.column("follow")[0].as_py()
    whole = whole[:follow - first - len(MAGIC)]
    values = parse(whole[:len(whole) - GAP])
    return pa.table([table.column("file")[:1], pa.array([first], pa.int64()), *(pa.array([v], t) for v, t in zip(values, _CANDIDATE_TYPES[6:]))],
                    names=["file", "place", *_CANDIDATE_NAMES[6:]])


def _place_keys(file: pa.Array, split: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each row's file, split and place in the split."""
    coded = file.dictionary_encode()
    names = [n.encode() for n in coded.dictionary.to_pylist()]
    h = np.array([span_hashes(np.frombuffer(n, np.uint8), np.array([0]), np.array([len(n)]))[0] for n in names], np.uint64)
    return chain(h[coded.indices.to_numpy()], split.astype(np.uint64), at.astype(np.uint64)) if len(names) else np.zeros(0, np.uint64)


def _keyed(batches):
    for rows in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_place_keys(*(rows.column("file"), *(rows.column(c).to_numpy() for c in ("split", "at")))).view(np.int64))], ["key"])


def _rows_in_order(shared):
    """file, split, at, rest of the rows of the archives that a filter of places lets through."""

    def run(batches):
        key, at = None, 0
        for rows in batches:
            places = []
            for file, split, size in zip(rows.column("file").to_pylist(), rows.column("split").to_pylist(), pc.binary_length(rows.column("rest")).to_pylist()):
                if (file, split) != key:
                    key, at = (file, split), 0
                places.append(at)
                at += size + len(MAGIC)
            place = pa.array(places, pa.int64())
            here = shared.value(_place_keys(rows.column("file"), rows.column("split").to_numpy(), place.to_numpy()))
            if here.any():
                yield pa.RecordBatch.from_arrays([rows.column("file"), rows.column("split"), place, rows.column("rest")], ["file", "split", "at", "rest"]).filter(pa.array(here))

    return run


def _mended(spark, path: str, broken: DataFrame, placed: DataFrame) -> DataFrame:
    """The records of ``broken(file, place, follow)``: their rows are found by ranges of places and put together again.

    Only rows that a filter of these places (64 MiB at most) lets through leave the tasks that read the archives.
    """
    span = 1 << 20
    grid = lambda a, b: F.explode(F.sequence(F.floor(a / span), F.floor(b / span)))
    ranges = broken.select("file", F.col("place").alias("record"), "follow", grid(F.col("place"), F.col("follow")).alias("cell"))
    inside = (placed.select("file", "split", "at", "place", F.floor(F.col("place") / span).alias("cell")).join(ranges, ["file", "cell"])
              .where("place >= record and place < follow").select("file", "split", "at", "place", "record", "follow"))
    inside = store(inside, "inside")
    places = Filter.of(inside.select("file", "split", "at").mapInArrow(_keyed, "key bigint"), inside.count())
    rows = scan(spark, path).mapInArrow(_rows_in_order(spark.sparkContext.broadcast(places)), "file string, split bigint, at bigint, rest binary").join(inside, ["file", "split", "at"])
    return rows.groupBy("file", "record").applyInArrow(_reassembled, "file string, place bigint, " + RECORD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``: file, place and the columns of RECORD.

    page_id and refers_to are the numbers in the record ids; payload_bytes and payload_digest are those of the full payload, read
    from the payload of responses and from the head and the declared digest of revisits. A file that doesn't start
    with the magic has no records; where a chain breaks off, what follows isn't reported.
    """
    found = store(scan(spark, path).mapInArrow(_candidates, _CANDIDATE), "candidates")
    # A split's rows start where those of the splits before it end; one row for each split is summed up.
    splits = found.groupBy("file", "split").agg(F.max("end").alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("file", "split", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"))
    placed = found.join(before, ["file", "split"]).withColumns({"place": F.col("before") + F.col("at"), "follow": F.when(F.col("next") >= 0, F.col("before") + F.col("next")).otherwise(-1)})
    placed = placed.where("place > 0")     # what precedes the first magic is no candidate
    nodes = placed.select("file", "split", "place", "follow")
    exits = store(nodes.groupBy("file", "split").applyInArrow(_shorten, "file string, place bigint, exit bigint"), "exits")
    starts = found.where(f"split = 0 and at = 0 and end = {len(MAGIC)}").select("file", F.lit(len(MAGIC)).cast("bigint").alias("place")).distinct()
    entries = _entries(exits.where("exit >= 0"), starts)
    first = nodes.join(entries, ["file", "place"], "left_semi").groupBy("file", "split").agg(F.min("place").alias("entry"))
    chain = store(nodes.join(first, ["file", "split"]).groupBy("file", "split").applyInArrow(_walk, "file string, place bigint, follow bigint"), "chain")
    records = chain.join(placed.drop("follow", "split"), ["file", "place"])
    complete = records.where("whole").select("file", "place", *(x.split()[0] for x in RECORD.split(", ")))
    broken = records.where("not whole").select("file", "place", "follow")
    return complete.unionByName(_mended(spark, path, broken, placed))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = os.path.join(checkpoint_root(spark), f"llm-warc-{uuid.uuid4().hex}")
    write_archives(pages, path)
    return read_archives(spark, path)
