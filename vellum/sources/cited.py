"""Citing and cited works as a Spark data source: lists of works read page by page along their cursors.

Pages of a list (seed, direction) are recorded once, into buckets of seeds, and read as the
format ``recorded_works``. A read has one partition per bucket. It follows the cursors of
every list from "*", stops at a missing page, an empty one, or ``cap`` works, and gives the
works with their places. As a stream the offset is a page number: a batch reads the pages
that were recorded since, of all lists, and a restart goes on at the page after the last
one, so nothing is repeated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from vellum.functions.identifiers import blank, normalize_doi
from vellum.session import ship
from vellum.sources.records import WORKS, percent_encode

FIRST_CURSOR = "*"
CAP = 200
PER_PAGE = 200
#: Pages parsed at once; a page has up to PER_PAGE works.
BATCH_PAGES = 512
ROWS = "seed string, direction string, place int, page int, total long, work string"
#: Fields asked for, as the remote service names them (fixed values).
SEED_FIELDS = "id,doi,display_name,cited_by_count,referenced_works"
WORK_FIELDS = "id,doi,display_name,publication_year,primary_location,cited_by_count,ids,type"


def record_pages(pages: DataFrame, path: str, buckets: int = 16) -> None:
    """Write pages (seed, direction, page, cursor, json) into buckets of seeds; each knows the place of its first work.

    Of pages of one list and number the one of the smallest text stays. Pages without a seed,
    direction, number or cursor are left out, as are those before which a page is missing or
    whose cursor is not the one that the page before names.
    """
    known = pages.select("seed", "direction", F.col("page").cast("int").alias("page"), "cursor", "json").dropna(subset=["seed", "direction", "page", "cursor"])
    one = known.groupBy("seed", "direction", "page").agg(F.min(F.struct(F.coalesce("json", F.lit("")).alias("json"), "cursor")).alias("p")).select("seed", "direction", "page", "p.*")
    read = F.from_json("json", "struct<meta: struct<next_cursor: string>, results: array<string>>")
    sized = one.withColumn("size", F.greatest(F.size(read["results"]), F.lit(0))).withColumn("next", read["meta"]["next_cursor"])
    order = Window.partitionBy("seed", "direction").orderBy("page")
    follows = F.when(F.col("page") == 0, F.col("cursor") == FIRST_CURSOR).otherwise((F.lag("page").over(order) == F.col("page") - 1) & F.coalesce(F.lag("next").over(order) == F.col("cursor"), F.lit(False)))
    linked = sized.withColumn("follows", F.coalesce(follows, F.lit(False))).withColumn("first", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    good = linked.withColumn("whole", F.min("follows").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("whole")
    rows = good.select(F.pmod(F.xxhash64("seed"), F.lit(buckets)).cast("int").alias("bucket"), "seed", "direction", "page", F.col("first").cast("int").alias("first"), "cursor", "json")
    rows.repartition("bucket").sortWithinPartitions("bucket", "page").write.partitionBy("bucket").mode("append").parquet(path)


class Bucket(InputPartition):
    """One bucket of a read, and the range of pages wanted."""

    def __init__(self, path: str, start: int, end: int | None):
        super().__init__(path)
        self.path, self.start, self.end = path, start, end


def _located(path: str) -> tuple[object, str]:
    """File system and path of an address, or of a local path."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def bucket_paths(path: str) -> list[str]:
    """Folders of the buckets of a recording; as many as it was written with."""
    from pyarrow.fs import FileSelector, FileType

    system, inner = _located(path)
    found = system.get_file_info(FileSelector(inner, allow_not_found=True))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.type == FileType.Directory and f.base_name.startswith("bucket="))


def _dataset(path: str) -> pads.Dataset:
    system, inner = _located(path)
    return pads.dataset(inner, format="parquet", filesystem=system)


def read_bucket(part: Bucket, cap: int) -> Iterator[pa.RecordBatch]:
    """Works of the wanted pages of a bucket; a list ends at an empty page and at ``cap`` works."""
    wanted = pads.field("first") < cap
    wanted &= pads.field("page") >= part.start
    if part.end is not None:
        wanted &= pads.field("page") < part.end
    # Read ahead, whole row groups of answers would wait in memory; a batch is parsed before the next one is read.
    ahead = {"batch_size": BATCH_PAGES, "batch_readahead": 0, "fragment_readahead": 0, "use_threads": False}
    for batch in _dataset(part.path).to_batches(columns=["seed", "direction", "page", "first", "json"], filter=wanted, fragment_scan_options=pads.ParquetFragmentScanOptions(use_buffered_stream=True, pre_buffer=False), **ahead):
        columns: list[list] = [[] for _ in range(6)]
        for seed, direction, page, first, text in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
            try:
                answer = json.loads(text)
            except ValueError:
                continue
            works = answer.get("results") if isinstance(answer, dict) else None
            total = (answer.get("meta") or {}).get("count") if isinstance(works, list) else None
            for k, work in enumerate((works if isinstance(works, list) else [])[: cap - first]):
                for column, value in zip(columns, (seed, direction, first + k, page, total if isinstance(total, int) else None, json.dumps(work, ensure_ascii=False)), strict=True):
                    column.append(value)
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["seed", "direction", "place", "page", "total", "work"])


class Reader(DataSourceReader):
    """All pages at once."""

    def __init__(self, path: str, cap: int):
        self.path, self.cap = path, cap

    def partitions(self) -> list[Bucket]:
        return [Bucket(p, 0, None) for p in bucket_paths(self.path)] or [Bucket("", 0, 0)]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        return read_bucket(partition, self.cap) if partition.path else iter([])


class StreamReader(DataSourceStreamReader):
    """Pages in the order of their numbers; an offset counts the pages of every list that are done."""

    def __init__(self, path: str, cap: int):
        self.path, self.cap = path, cap

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        most = -1
        for path in bucket_paths(self.path):
            for fragment in _dataset(path).get_fragments():
                most = max([most, *(group.statistics["page"]["max"] for group in fragment.row_groups if group.statistics)])
        return {"page": most + 1}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        return [Bucket(p, start["page"], end["page"]) for p in bucket_paths(self.path)]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        return read_bucket(partition, self.cap)

    def commit(self, end: dict) -> None:
        pass


class RecordedWorks(DataSource):
    """Format ``recorded_works`` with options path and cap."""

    @classmethod
    def name(cls) -> str:
        return "recorded_works"

    def schema(self) -> str:
        return ROWS

    def _cap(self) -> int:
        return int(self.options.get("cap", CAP))

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._cap())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"], self._cap())


def read_works(spark: SparkSession, path: str, cap: int = CAP, streaming: bool = False) -> DataFrame:
    """``seed, direction, place, page, total, work`` (JSON) of a recording, as a table or as a stream."""
    spark.dataSource.register(RecordedWorks)
    reader = (spark.readStream if streaming else spark.read).format("recorded_works").option("path", path).option("cap", cap)
    return reader.load()


def parsed_works(rows: DataFrame) -> DataFrame:
    """Works as columns: seed, direction, place, work, doi, title, year, kind, cited_by, pmid."""
    one = WORKS.split("results: array<", 1)[1].rsplit(">>", 1)[0]
    w = F.from_json("work", one)
    return rows.select(
        "seed", "direction", "place", F.upper(F.regexp_extract(blank(w["id"]), r"(?i)(W\d+)\s*$", 1)).alias("work"), normalize_doi(w["doi"]).alias("doi"), blank(w["display_name"]).alias("title"), w["publication_year"].alias("year"),
        w["type"].alias("kind"), F.coalesce(w["cited_by_count"], F.lit(0)).alias("cited_by"), F.regexp_extract(blank(w["ids"]["pmid"]), r"(\d+)/?$", 1).alias("pmid"),
    )


def list_reports(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """``seed, direction, works, total, capped`` of each list: how many were read, how many there are, and whether the cap or the recording cut it short."""
    counts = rows.groupBy("seed", "direction").agg(F.count(F.lit(1)).alias("works"), F.max_by("total", F.struct(F.col("total").isNotNull(), -F.col("place"))).alias("total"))
    total = F.coalesce("total", F.col("works"))
    return counts.select("seed", "direction", "works", total.alias("total"), ((total > F.col("works")) | (F.col("works") > cap)).alias("capped"))


def _kept(column: Column, signs: str) -> Column:
    """Percent-encoded, but for some signs that stay readable, as the unreserved ones do."""
    out = percent_encode(column)
    for sign in "()!'~" + signs:
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return out


def _query(params: list[tuple[str, Column]]) -> Column:
    pairs = [F.when(blank(value) != "", F.concat(F.lit(f"{name}="), _kept(value, ":,|@"))) for name, value in params]
    joined = F.array_join(F.filter(F.array(*pairs), lambda p: p.isNotNull()), "&")
    return F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined))


def seed_address(base: str, doi: Column, pmid: Column, email: Column | None = None) -> Column:
    """Address of a seed's own record, by DOI or else by PubMed number; null without either."""
    clean, number = normalize_doi(doi), F.regexp_extract(blank(pmid), r"(\d+)", 1)
    name = F.when(blank(clean) != "", F.concat(F.lit("doi:"), _kept(clean, "/"))).when(number != "", F.concat(F.lit("pmid:"), number))
    return F.concat(F.lit(f"{base}/works/"), name, _query([("select", F.lit(SEED_FIELDS)), ("mailto", F.lit("") if email is None else email)]))


def list_address(base: str, seed_work: Column, direction: Column, cursor: Column, per_page: int = PER_PAGE, email: Column | None = None) -> Column:
    """Address of one page of a seed's references (``backward``) or citing works (``forward``), the most cited first."""
    of = F.concat(F.when(direction == "backward", "cited_by:").when(direction == "forward", "cites:"), seed_work)
    parts = [("filter", of), ("select", F.lit(WORK_FIELDS)), ("sort", F.lit("cited_by_count:desc")), ("per-page", F.lit(str(per_page))), ("cursor", F.coalesce(F.nullif(cursor, F.lit("")), F.lit(FIRST_CURSOR))), ("mailto", F.lit("") if email is None else email)]
    return F.when(of.isNotNull(), F.concat(F.lit(f"{base}/works"), _query(parts)))


ship(__name__)
