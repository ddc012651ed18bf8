"""WARC files and their Merkle fixity audit: replicas are compared from the roots, down mismatching branches only."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelake.llm.common import make_folder, materialize, named

CRLF = "\r\n"
SCHEMA = "file string, record_id string, uri string, kind string, date string, offset long, length long, sha string, payload binary"
TYPES = (pa.string(),) * 5 + (pa.int64(),) * 2 + (pa.string(), pa.binary())


def warc_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "1970-01-01T00:00:00Z", per_file: int = 4096, carry: Sequence[str] = ()) -> DataFrame:
    """(id, file, length, record, and the columns of carry): a WARC/1.1 resource record for each page.

    Pages lie by id in files of ``per_file`` consecutive ids, so a lost page shifts the rest of its own file only. Null
    url and body are empty; pages without an id lie in the file of none. Line ends in a url become spaces, lest they end
    its header. A file is written by one task: ids are taken to be keys, and a repeated one makes its file longer.
    """
    body, url = F.coalesce(F.col(body_col), F.lit("")), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\r\n]", " ")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("none")), F.lit(f">{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2),
    )
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.concat(head, body, F.lit(CRLF * 2)).alias("record"), *carry).withColumn("length", F.octet_length("record").cast("long"))
    return rows.withColumn("file", floor_div(F.col("id"), per_file)).select("id", "file", "length", "record", *carry)


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records in order of id, then bytes, a gzip file below path/file=N for each ``file``; line ends are part of the records."""
    write_gathered(records.repartition("file"), path, "file")


def write_replicas(pages: DataFrame, path: str, replicas: Sequence[tuple[F.Column, F.Column]], *, id_col: str = "page_id", body_col: str = "html", per_file: int = 4096, **options: str) -> list[str]:
    """Folders path/replica=0, 1, ... with the files that write_warc would write for each replica of pages.

    A replica is a condition, which rows of pages it has, and the body of these rows; both may use any column of pages
    but one named replica. Pages are shuffled once, however many replicas there are: these are made where a file's pages
    have met, so disk holds one copy of them in the shuffle besides the files. options are those of warc_records.
    """
    met = pages.repartition(floor_div(named(id_col).cast("long"), per_file))
    copies = met.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(len(replicas) - 1))))
    of = lambda columns: F.coalesce(*[F.when(F.col("replica") == i, c) for i, c in enumerate(columns)])
    copies = copies.where(of([held for held, _ in replicas])).withColumn(body_col, of([body for _, body in replicas]))
    write_gathered(warc_records(copies, id_col=id_col, body_col=body_col, per_file=per_file, carry=["replica"], **options), path, "replica", "file")
    folders = [f"{path}/replica={i}" for i in range(len(replicas))]
    make_folder(pages.sparkSession, *folders)  # a replica without rows has none yet
    return folders


def write_gathered(records: DataFrame, path: str, *folders: str) -> None:
    """Writes records, those of a file in one partition, by the columns folders; these are no strings, for which Spark would sort again."""
    ordered = records.sortWithinPartitions(*folders, "id", "record")
    ordered.select(*folders, F.substring("record", F.lit(1), F.length("record") - 2).alias("value")).write.partitionBy(*folders).option("lineSep", CRLF).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """Records of the WARC files below path, plain or gzip: SCHEMA, payload only if asked for.

    file is the path below ``path`` (of write_warc's files the folder's name), offset and length count bytes of the
    inflated file, sha is over the whole raw record. Bytes between records, and what can't be inflated or parsed, are
    rows of kind 'gap', so every byte is in one row. A file is one task's, inflated and parsed in slices; Spark reads
    files of up to 2 GB so. No files, or empty ones, give no rows.
    """
    n = len(TYPES) - (not payload)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(TYPES[:n])], names=[c.split()[0] for c in SCHEMA.split(", ")[:n]])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, held = [], 0
                for row in parse_warc(inflated(content.as_buffer())):
                    rows.append((name, *row))
                    held += len(row[-1]) if payload else 256
                    if held > 1 << 22:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toUri().getPath()
    below = F.regexp_replace(F.substring_index("path", root + "/", -1), r"^(file=[^/]+)/part-[^/]*$", "$1")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(below.alias("name"), "content").mapInArrow(parse, ", ".join(SCHEMA.split(", ")[:n]))


def inflated(content: pa.Buffer, slice_bytes: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a file in slices; gzip members are inflated, from a damaged place on the rest comes as it is."""
    zipped, size = content[:2].to_pybytes() == b"\x1f\x8b", len(content)
    member, at, rest = zlib.decompressobj(31), 0, b""
    while rest or at < size:
        piece = rest or content[at : at + slice_bytes].to_pybytes()
        at += 0 if rest else len(piece)
        rest = b""
        if not zipped:
            yield piece
            continue
        try:
            out = member.decompress(piece, 1 << 20)
        except zlib.error:
            zipped = False
            yield piece
            continue
        if member.eof:
            rest, member = member.unused_data, zlib.decompressobj(31)
        else:
            rest = member.unconsumed_tail
        if out:
            yield out


def parse_warc(chunks: Iterator[bytes]) -> Iterator[tuple]:
    """(record id, uri, kind, date, offset, length, sha, payload) of each record and gap, in order."""
    held, at = bytearray(), 0

    def filled(size: int) -> bool:
        while len(held) < size and (chunk := next(chunks, b"")):
            held.extend(chunk)
        return len(held) >= size

    def sought(mark: bytes, start: int) -> int:
        """First place of mark from start on, or -1; each byte is searched once."""
        while (found := held.find(mark, start)) < 0:
            start = max(start, len(held) - len(mark) + 1)
            if not filled(len(held) + 1):
                return -1
        return found

    def cut(size: int, fields: tuple, lo: int, hi: int) -> tuple:
        nonlocal at
        row = (*fields, at, size, hashlib.sha256(memoryview(held)[:size]).hexdigest(), bytes(held[lo:hi]))
        del held[:size]
        at += size
        return row

    while filled(1):
        start = sought(b"WARC/", 0)
        head = sought(b"\r\n\r\n", start) if start >= 0 else -1
        if start or head < 0:
            gap = start if start > 0 else len(held)
            yield cut(gap, (None, None, "gap", None), 0, gap)
            continue
        lines = held[:head].decode("utf-8", "replace").split(CRLF)[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = fields.get("content-length", "")
        lo = head + 4
        hi = lo + (int(size) if size.isascii() and size.isdigit() and len(size) < 16 else 0)
        whole = filled(hi + 4) and held[hi : hi + 4] == b"\r\n\r\n"
        hi = min(hi, len(held))
        yield cut(hi + 4 * whole, tuple(fields.get(k) for k in ("warc-record-id", "warc-target-uri", "warc-type", "warc-date")), lo, hi)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, sha, length, file, offset) of a replica's files, for fixity_audit; gaps have no id."""
    return read_warc(spark, path, payload=False).select(F.col("record_id").alias("id"), "sha", "length", "file", "offset")


def merkle_levels(digests: DataFrame, top: int, fan: int) -> list[DataFrame]:
    """Tables (node, sha), from leaves 0 to top up to one root: node i of a level covers the leaves [i * fan**level, (i + 1) * fan**level).

    A node's hash is over its children's places and hashes in order; a leaf's children are its records, at their offsets. A
    level has at most 1/fan of the places below, and a group at most fan rows, in a leaf as many as records start in its range.
    """
    node = lambda of, sha: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(of, sha))), lambda x: F.concat(x["k"].cast("string"), F.lit(":"), x["sha"])), ","), 256)
    levels = [materialize(digests.where("leaf IS NOT NULL").groupBy(F.col("leaf").alias("node")).agg(node(F.col("offset").alias("k"), F.col("sha")).alias("sha")), "level")]
    while top:
        top //= fan
        below = levels[-1]
        levels.append(materialize(below.groupBy(floor_div(F.col("node"), fan).alias("up")).agg(node(F.col("node").alias("k"), F.col("sha")).alias("sha")).withColumnRenamed("up", "node"), "level"))
    return levels


def floor_div(number: F.Column, of: int) -> F.Column:
    """Floor of number / of, exact for all longs."""
    return F.call_function("div", number - F.pmod(number, F.lit(of).cast("long")), F.lit(of).cast("long"))


def file_ranks(files: DataFrame) -> tuple[DataFrame, int]:
    """(file, rank) of the distinct files from 0 in order, and how many: ranks in ordered partitions plus those of the partitions before."""
    ordered = materialize(files.distinct().repartitionByRange("file").sortWithinPartitions("file").withColumn("part", F.spark_partition_id()), "files")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    starts = parts.withColumn("start", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("file")) - 1
    return ordered.join(F.broadcast(starts), "part").select("file", rank.alias("rank")), ordered.count()


def fixity_audit(left: DataFrame, right: DataFrame, *, fan: int = 16, span: int = 1 << 16, moved: bool = False) -> DataFrame:
    """Records in which two replicas differ: (id, status, file, offset, length, left_sha, right_sha).

    left, right: (id, sha, length, file, offset), as read_digests() gives them. A leaf covers the records that start in
    ``span`` bytes of a file, by offset; above lie wider ranges of the file, the file, runs of files in order, the root.
    Files of the same name are compared; names are numbered without holes, so neither sparse names nor long files cost
    levels. Equal roots end the audit after one comparison; else each level compares the children of mismatching nodes only.

    status is 'corrupt', 'missing' (from right) or 'extra' (in right); file, offset and length are those of the left
    record, of the right one where there is no left. A record with equal bytes at another place opens its leaves, but is
    reported, as 'moved', only if ``moved``: a lost record moves all behind it in its file.

    Defined cases: empty replicas have no root, all records of the other are missing or extra; repeated ids are
    compared as a set of records, and each differing one is reported; records without an id (gaps too) are
    missing or extra; rows without a file have no place in a tree and are compared by hash.
    """
    tables = [materialize(t.select("id", "sha", "length", "file", "offset"), "digests") for t in (left, right)]
    ranks, n_files = file_ranks(tables[0].select("file").unionByName(tables[1].select("file")).where("file IS NOT NULL"))
    last = max(t.agg(F.max("offset")).first()[0] or 0 for t in tables) // span
    wide = 1  # leaves a file
    while wide <= last:
        wide *= fan
    leaf = F.col("rank") * F.lit(wide) + F.expr(f"offset div {span}L")
    a, b = (materialize(t.join(ranks, "file", "left").withColumn("leaf", leaf).drop("rank"), "placed") for t in tables)
    top = max(n_files, 1) * wide - 1
    trees = list(zip(merkle_levels(a, top, fan), merkle_levels(b, top, fan), strict=True))
    open_nodes: DataFrame | None = None
    for x, y in reversed(trees):
        if open_nodes is not None:
            x, y = (t.withColumn("up", floor_div(F.col("node"), fan)).join(open_nodes, "up", "left_semi") for t in (x, y))
        differ = x.select("node", F.col("sha").alias("l")).join(y.select("node", F.col("sha").alias("r")), "node", "full_outer").where("NOT l <=> r")
        open_nodes = materialize(differ.select(F.col("node").alias("up")), "open")
        if not open_nodes.take(1):
            break
    hits = open_nodes.withColumnRenamed("up", "leaf")
    pick = lambda t: t.join(hits, "leaf", "left_semi").select(t.columns).unionByName(t.where("file IS NULL")).withColumn("nth", F.row_number().over(Window.partitionBy("id", "sha").orderBy("file", "offset")))
    x, y = pick(a), pick(b)
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")) & (F.col("nth") == F.col("k"))
    keys = lambda t, *more: t.select(F.col("id").alias("i"), F.col("sha").alias("s"), F.col("nth").alias("k"), *more)
    gone, new = (p.join(keys(q), same, "left_anti") for p, q in ((x, y), (y, x)))
    rank = Window.partitionBy("id").orderBy("sha", "nth")
    place = F.struct("file", "offset", "length", "sha").alias("at")
    gone, new = (t.select("id", F.when(F.col("id").isNotNull(), F.row_number().over(rank)).otherwise(F.xxhash64("sha", "nth", F.lit(sign))).alias("k"), place) for t, sign in ((gone, 1), (new, 3)))
    both = gone.select("id", "k", F.col("at").alias("l")).join(new.select("id", "k", F.col("at").alias("r")), ["id", "k"], "full_outer")
    # Null ids never join, so each is missing or extra.
    at = F.coalesce("l", "r")
    found = both.select("id", F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("corrupt").alias("status"), at["file"].alias("file"), at["offset"].alias("offset"), at["length"].alias("length"), F.col("l.sha").alias("left_sha"), F.col("r.sha").alias("right_sha"))
    if not moved:
        return found
    there = keys(y, F.col("file").alias("to_file"), F.col("offset").alias("to_offset"))
    elsewhere = x.join(there, same).where("NOT (file <=> to_file AND offset <=> to_offset)")
    return found.unionByName(elsewhere.select("id", F.lit("moved").alias("status"), "file", "offset", "length", F.col("sha").alias("left_sha"), F.col("sha").alias("right_sha")))
