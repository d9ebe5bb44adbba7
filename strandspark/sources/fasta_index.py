"""Random access to FASTA: an index table of byte offsets, reads of named regions by byte range, and a data source over the index.

The index is built in byte ranges of the files, so that neither a file nor a record is one task: each range reports the records that
begin in it and what it holds of the one before; only those at its edges are put together. An index row has the file, the
record's name and attributes, offset and stop (the bytes of its lines), length in bases, and width and step, bases and bytes of a full line. Where
lines differ in width both are null, and such a record is read whole. Files may be in any store that pyarrow's file systems reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..operators.ordered import checkpoint
from .files import located, opened

#: Bytes of a file that a task scans, of one read while it does, and of a partition of the data source, about.
SPLIT, READ, PART = 32 << 20, 1 << 20, 16 << 20
#: Bases of a row of the data source, by default.
STRETCH = 1 << 16
PIECES = pa.schema(
    [("file", pa.string()), ("split", pa.int64()), ("ordinal", pa.int32()), ("head", pa.string()), ("offset", pa.int64()), ("stop", pa.int64())]
    + [
        ("bases", pa.int64()),
        ("lines", pa.int32()),
        ("width", pa.int64()),
        ("step", pa.int64()),
        ("even", pa.bool_()),
        ("full", pa.bool_()),
        ("edge", pa.bool_()),
    ]
)
PIECES_DDL = "file string, split long, ordinal int, head string, offset long, stop long, bases long, lines int, width long, step long, even boolean, full boolean, edge boolean"
BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def whole_lines(source, size: int, start: int, stop: int) -> tuple[int, bytes]:
    """(offset, bytes) of the lines that begin in start to stop; the offset is -1 if none does."""
    at = start
    if start:  # the first line begins after a newline from the byte before on
        at = -1
        for lo in range(start - 1, stop - 1, READ):
            found = source.read_at(min(READ, stop - 1 - lo), lo).find(b"\n")
            if found >= 0:
                at = lo + found + 1
                break
    if at < 0 or at >= size:
        return -1, b""
    parts = [source.read_at(min(stop, size) - at, at)]
    end = min(stop, size)
    while end < size and not parts[-1].endswith(b"\n"):  # the last line goes on
        more = source.read_at(READ, end)
        cut = more.find(b"\n") + 1
        parts.append(more[:cut] if cut else more)
        end += len(parts[-1])
    return at, b"".join(parts)


def pieces_of(text: bytes, at: int) -> list[tuple]:
    """(head, offset, stop, bases, lines, width, step, even, full) of each stretch of lines under one header; the first may have none (null)."""
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if not len(ends) or ends[-1] < len(data):
        ends = np.append(ends, len(data))
    starts = np.concatenate(([0], ends[:-1]))
    size = ends - starts
    blanks = np.flatnonzero(BLANKS[data])
    bases = size - (np.searchsorted(blanks, ends) - np.searchsorted(blanks, starts))
    # clean: bases first, then at most a carriage return and a newline
    newline = data[ends - 1] == 10
    returned = newline & (size > 1) & (data[np.maximum(ends - 2, 0)] == 13)
    clean = bases == size - newline - returned
    heads = np.flatnonzero(data[starts] == 62)
    firsts = np.concatenate(([-1], heads)) if not len(heads) or heads[0] else heads
    out = []
    for k, h in enumerate(firsts.tolist()):
        a, b = h + 1, int(firsts[k + 1]) if k + 1 < len(firsts) else len(starts)
        head = None if h < 0 else text[starts[h] : ends[h]].decode(errors="replace").strip()
        offset, stop = int(ends[h]) if h >= 0 else 0, int(ends[b - 1]) if b > a else int(ends[h])
        n, own = int(bases[a:b].sum()), np.flatnonzero(bases[a:b] > 0)
        if not len(own):
            out.append((head, at + offset, at + stop, 0, 0, None, None, True, b == a))
            continue
        last = a + int(own[-1])
        width, step = int(bases[a]), int(size[a])
        inner = slice(a, last)
        even = bool((bases[inner] == width).all() and (size[inner] == step).all() and clean[a : last + 1].all() and bases[last] <= width)
        full = bool(even and last == b - 1 and bases[last] == width and size[last] == step and newline[last])
        out.append((head, at + offset, at + stop, n, last + 1 - a, width, step, even, full))
    return out


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, size, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "start", "stop")), strict=True):
            with opened(file) as source:
                at, text = whole_lines(source, size, start, stop)
            if at < 0:
                continue
            found = pieces_of(text, at)
            rows = [(file, start, k, *p, k == len(found) - 1 or p[0] is None) for k, p in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)


def build(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """file, name, attrs, offset, stop, length, width, step of each record of the FASTA files at path.

    name: the header's first word; attrs: its k=v entries between '; '. A record without lines has length 0. Sequence before a file's first header belongs
    to no record. Write the result as Parquet to keep it. The files are scanned once, when this is called.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    ranges = files.where("size > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))))
    # a range is a few bytes here and megabytes to scan: with a number of partitions given, small ones aren't merged into a task for all
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.withColumn("stop", F.col("start") + split).repartitionByRange(n, "file", "start")
    found = checkpoint(ranges.mapInArrow(_scanned, PIECES_DDL))  # both kinds of pieces are read from it
    inner = found.where("not edge").select(
        "file",
        "head",
        "offset",
        "stop",
        "bases",
        F.when(F.col("even"), F.col("width")).alias("width"),
        F.when(F.col("even"), F.col("step")).alias("step"),
    )
    return _described(inner.unionByName(_joined(found.where("edge"))))


def _joined(edges: DataFrame) -> DataFrame:
    """Records from the pieces at ranges' edges, at most two of a range."""
    order = Window.partitionBy("file").orderBy("split", "ordinal")
    owner = F.last(F.when(F.col("head").isNotNull(), F.struct("head", "offset")), ignorenulls=True).over(order)
    piece = F.struct("split", "ordinal", "stop", "bases", "lines", "width", "step", "even", "full")
    # a piece a range
    records = edges.withColumn("owner", owner).where("owner is not null").groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(piece)).alias("p")
    )
    held = F.filter("p", lambda x: x["bases"] > 0)
    first = F.get("h", F.lit(0))
    last = F.size("h") - 1
    # all but the last piece with bases end with a full line, and all have the same lines; a single shorter line may be the last
    alike = F.forall(
        F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda t: t["x"]["even"] & ((t["i"] == last) | t["x"]["full"])
        & (
            ((t["x"]["width"] == first["width"]) & (t["x"]["step"] == first["step"])) | (
                (t["i"] == last) & (t["x"]["lines"] == 1) & (t["x"]["width"] <= first["width"])
            )
        ),
    )
    # what lies between them and has no bases must have no lines either
    gaps = F.exists(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: (x["bases"] == 0) & ~x["full"])
    rows = records.withColumn("h", held).withColumn("ok", (F.size("h") > 0) & alike & ~gaps)
    total = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["bases"])
    return rows.select(
        "file",
        "owner.head",
        "owner.offset",
        F.element_at("p", -1)["stop"].alias("stop"),
        total.alias("bases"),
        F.when(F.col("ok"), first["width"]).alias("width"),
        F.when(F.col("ok"), first["step"]).alias("step"),
    )


def _described(rows: DataFrame) -> DataFrame:
    text = F.regexp_replace("head", r"^>\s*", "")
    entries = F.filter(F.split(F.trim(F.regexp_replace(text, r"^\S+", "")), r";\s*"), lambda x: x.contains("="))
    attrs = F.map_from_entries(F.transform(entries, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.trim(F.regexp_replace(x, r"^[^=]*=", "")))))
    return rows.select(
        "file",
        F.regexp_extract(text, r"^(\S*)", 1).alias("name"),
        attrs.alias("attrs"),
        "offset",
        "stop",
        F.col("bases").alias("length"),
        "width",
        "step",
    )


def _range(start, end) -> tuple:
    """Columns of the first byte and the one after the last of bases start to end (from 1); the whole record where lines differ."""
    byte = lambda base: F.col("offset") + F.floor((base - 1) / F.col("width")) * F.col("step") + F.pmod(base - 1, F.col("width"))
    none = end < start
    return F.when(
        none | F.col("width").isNull(), F.col("offset")
    ).otherwise(byte(start)), F.when(none, F.col("offset")).when(F.col("width").isNull(), F.col("stop")).otherwise(byte(end) + 1)


def stripped(text: bytes) -> bytes:
    return text.translate(None, b" \t\n\r\v\f")


def fetch(regions: DataFrame, index: DataFrame) -> DataFrame:
    """regions (name, start, end and other columns) with seq and n_read, the bytes that were read for it.

    start and end count from 1, both included; null or 0: from the first base, to the last. A region beyond its record fails, as does
    a name that several records have. A name that the index lacks gives a null seq. Reads are dealt by place in the files, so a name that many regions share is not one task's.
    """
    keep = regions.columns
    once = index.groupBy("name").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("file", "offset", "stop", "length", "width", "step")])
    rows = regions.select(
        F.struct("*").alias("_row"),
        "name",
        F.coalesce(F.nullif("start", F.lit(0)), F.lit(1)).cast("long").alias("_start"),
        F.nullif("end", F.lit(0)).cast("long").alias("_end"),
    )
    rows = rows.join(once, "name", "left").withColumn("_end", F.coalesce("_end", "length"))
    wrong = F.when(F.col("_n") > 1, F.concat(F.lit("several records are called "), F.col("name")))
    wrong = wrong.when(
        (F.col("_start") < 1) | (F.col("_end") > F.col("length")) | (F.col("_end") < F.col("_start") - 1),
        F.concat(F.lit("region out of range: "), F.col("name")),
    )
    a, b = _range(F.col("_start"), F.col("_end"))
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(a.cast("long"))
    asked = rows.select(
        "_row",
        "file",
        checked.alias("_a"),
        b.cast("long").alias("_b"),
        F.when(F.col("width").isNull(), F.col("_start")).alias("_s"),
        F.when(F.col("width").isNull(), F.col("_end")).alias("_e"),
    )
    n = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = asked.repartitionByRange(n, "file", "_a").sortWithinPartitions("file", "_a")
    kinds = {f.name: f.dataType.simpleString() for f in regions.schema}
    read = placed.mapInArrow(_read_regions, f"_row struct<{','.join(f'`{c}`:{k}' for c, k in kinds.items())}>, seq string, n_read long")
    return read.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep if c not in ("seq", "n_read")], "seq", "n_read")


def _read_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, source = None, None
    for batch in batches:
        seqs, read = [], []
        for file, a, b, s, e in zip(*(batch.column(c).to_pylist() for c in ("file", "_a", "_b", "_s", "_e")), strict=True):
            if file is None:
                seqs.append(None)
                read.append(0)
                continue
            if file != name:
                if source:
                    source.close()
                name, source = file, opened(file)
            text = stripped(source.read_at(b - a, a)) if b > a else b""
            read.append(b - a)
            seqs.append((text if s is None else text[s - 1 : e]).decode("latin-1"))
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(seqs, pa.string()), pa.array(read, pa.int64())], names=["_row", "seq", "n_read"])
    if source:
        source.close()


class Ranges(InputPartition):
    """Stretches of records: (file, name, first base, bases, first byte, stop, whether lines are even)."""

    def __init__(self, stretches: list[tuple]) -> None:
        self.stretches = stretches


class IndexedFasta(DataSource):
    """format("indexed_fasta").load(path of an index in Parquet): name, start (from 1), seq in stretches of the option `stretch`.

    Partitions are planned from the index: byte ranges of about PART bytes. Filters on name (= and in) are pushed down, so that other records' bytes
    aren't read; the driver holds index rows of the names asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "indexed_fasta"

    def schema(self) -> str:
        return "name string, start long, seq string"

    def reader(self, schema) -> DataSourceReader:
        return IndexedReader(self.options["path"], int(self.options.get("stretch", STRETCH)))


class IndexedReader(DataSourceReader):
    def __init__(self, path: str, stretch: int) -> None:
        self.path, self.stretch, self.names = path, stretch, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("name",):
                found = set(f.value) if isinstance(f, In) else {f.value}
                self.names = found if self.names is None else self.names & found
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        import pyarrow.dataset as ds

        system, path = located(self.path)
        index = ds.dataset(path, filesystem=system, format="parquet")
        wanted = None if self.names is None else ds.field("name").isin(sorted(self.names))
        rows = index.to_table(
            columns=["file", "name", "offset", "stop", "length", "width", "step"], filter=wanted
        ).sort_by([("file", "ascending"), ("offset", "ascending")])
        out, held, size = [], [], 0
        for r in rows.to_pylist():
            for s in self._stretches(r):
                held.append(s)
                size += s[5] - s[4]
                if size >= PART:
                    out.append(Ranges(held))
                    held, size = [], 0
        return [*out, Ranges(held)] if held or not out else out

    def _stretches(self, r: dict) -> Iterator[tuple]:
        if r["width"] is None:
            yield r["file"], r["name"], 1, r["length"], r["offset"], r["stop"], False
            return
        byte = lambda base: r["offset"] + (base - 1) // r["width"] * r["step"] + (base - 1) % r["width"]
        for start in range(1, r["length"] + 1, self.stretch):
            end = min(r["length"], start + self.stretch - 1)
            yield r["file"], r["name"], start, end - start + 1, byte(start), byte(end) + 1, True

    def read(self, partition: Ranges) -> Iterator[tuple]:
        name, source = None, None
        for file, record, start, bases, a, b, even in partition.stretches:
            if file != name:
                if source:
                    source.close()
                name, source = file, opened(file)
            text = stripped(source.read_at(b - a, a)).decode("latin-1")
            for k in range(0, bases, bases if even else self.stretch):
                yield record, start + k, text[k : k + (bases if even else self.stretch)]
        if source:
            source.close()


def register(spark: SparkSession) -> None:
    """Makes format("indexed_fasta") known to the session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedFasta)
