"""Continuous import: exports that land in a folder are migrated once each."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemigrate.plans.importing import ImportOptions, import_exports
from sitemigrate.sources import exports
from sitemigrate.sources.site import SiteTables
from sitemigrate.sources.site_log import SiteLog, TableLog
from sitemigrate.storage import discard, keep, scratch_dir


#: What ``collect_items`` keeps of each item.
ITEMS = {"items": "item_hash string, export_id string, modified timestamp, item_xml string"}
#: Bitmaps of places (4 KB each) that go to all tasks at most; beyond that, items meet them by a shuffle.
BITMAPS = 16_384
#: The least number of tasks that read files; files are cut alike in all scans of a micro-batch as long as it is fixed.
CUTS = "spark.sql.files.minPartitionNum"


def _arriving(spark: SparkSession, path: str) -> DataFrame:
    """Names and times of the files that arrive in a folder, as a stream, without their contents."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1000").load(path)
    return files.select("path", "modificationTime")


def _run(names: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool):
    writer = names.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def collect_items(spark: SparkSession, path: str, out_path: str, checkpoint: str, keep_for: str = "7 days", available_now: bool = False):
    """A running query that adds the items of arriving export files to a log of ``ITEMS`` at ``out_path``, each content once.

    An item that is like one whose file is at most ``keep_for`` older is left out, across micro-batches and within one. Items
    are whole ones, as in the import (``read_chunks``): an open CDATA section is carried over the pieces and blocks of a file,
    so items that differ only after an ``</item>`` in their text are told apart. What was seen is the log itself; a
    micro-batch commits its version last, so one that is run again adds nothing twice.

    Items are picked by their hashes and places. A second scan of the files writes those that are picked from where they
    were read, by bitmaps of places (a bit for each item), so no text is shuffled but for items that go on in another block.
    """
    cuts = spark.conf.get(CUTS, None)

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        log = TableLog(session, out_path, ITEMS)
        files = whole_exports(session, [r["path"] for r in batch.select("path").distinct().collect()])  # names of one micro-batch
        if not files or number in log.versions():
            return
        session.conf.set(CUTS, cuts or str(session.sparkContext.defaultParallelism))
        folder = scratch_dir(session)
        times = F.broadcast(batch.select(exports.export_of(F.col("path")).alias("export_id"), "modificationTime").groupBy("export_id").agg(F.max("modificationTime").alias("modified")))
        places, items = _items(session, files, folder)
        items = items.join(times, "export_id").withColumn("item_hash", F.sha2("item_xml", 256))
        first = places.join(times, "export_id").groupBy("item_hash").agg(F.min(F.struct("modified", "export_id", "doc_pos")).alias("x")).select("item_hash", "x.modified", "x.doc_pos.row")
        seen = log.tables()["items"].groupBy("item_hash").agg(F.max("modified").alias("seen"))
        fresh = first.join(seen, "item_hash", "left").filter(F.col("seen").isNull() | (F.col("seen") + F.expr(f"INTERVAL {keep_for}") < F.col("modified")))
        log.commit({"items": _at(session, items, fresh.select("row"), folder).select("item_hash", "export_id", "modified", "item_xml")}, number)
        discard(session, folder)

    return _run(_arriving(spark, path), handle, checkpoint, available_now)


def _items(session: SparkSession, files: list[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """Places and hashes (``item_hash``) of all items of the files, and ``read_items`` by one more scan.

    What is known of blocks, the hashes of items in torn exports, and items that go on in another block are kept in
    ``folder``: the scan that joins torn items gives both, so their texts are read three times in all.
    """
    hashed = lambda chunks: exports.split_chunks(chunks)[0].select("export_id", "doc_pos", F.sha2("item_xml", 256).alias("item_hash"))
    chunks = exports.scan_chunks(session, files)
    blocks = keep(session, exports.blocks_of(chunks), f"{folder}/blocks")
    torn = blocks.filter("any_open").select("export_id").distinct()
    if torn.isEmpty():
        return hashed(chunks), exports.split_chunks(chunks)[0]
    pieces, goes_on = exports.pieces_in_place(chunks, blocks), F.col("origin").isNotNull()
    read = pieces.select("export_id", "doc_pos", "origin", F.when(~goes_on, F.sha2(exports.item_of("chunk"), 256)).alias("item_hash"), F.when(goes_on, F.col("chunk")).alias("chunk"))
    read = keep(session, read, f"{folder}/pieces")
    others = keep(session, exports.joined_over(read), f"{folder}/over")
    if not blocks.join(torn, "export_id", "left_anti").isEmpty():  # else no second scan, of which nothing is left
        others = exports.whole_chunks(chunks, torn).unionByName(others)
    places = read.filter("item_hash IS NOT NULL").select("export_id", "doc_pos", "item_hash").unionByName(hashed(others))
    return places, exports.split_chunks(others.unionByName(pieces.filter("origin IS NULL").drop("origin")))[0]


def _at(session: SparkSession, items: DataFrame, rows: DataFrame, folder: str) -> DataFrame:
    """Those ``items`` whose ``doc_pos.row``, which no other item of the scan has, is in ``rows``; bitmaps are kept in ``folder``."""
    bucket, bit = F.bitmap_bucket_number("doc_pos.row"), F.bitmap_bit_position("doc_pos.row")
    placed = rows.select(F.bitmap_bucket_number("row").alias("__bucket"), F.bitmap_bit_position("row").alias("__bit")).repartition("__bucket")
    maps = keep(session, placed.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits")), f"{folder}/bitmaps")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    is_set = F.getbit(byte, (bit % 8).cast("int")) == 1
    return items.join(F.broadcast(maps) if maps.count() <= BITMAPS else maps, (bucket == F.col("__bucket")) & is_set, "left_semi")


def whole_exports(spark: SparkSession, files: list[str]) -> list[str]:
    """What to import of the files of a micro-batch: single files, and folders of exports in parts with their last part.

    An export in parts comes as a whole folder (written elsewhere, then moved in), but its files may fall into several
    batches; it is imported once, in the batch that has the last one.
    """
    of = {f: re.match(exports.PART, f) for f in files}
    out = [f for f, m in of.items() if m is None]
    for folder in sorted({m[1] for m in of.values() if m}):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
        there = [str(s.getPath().getName()) for s in jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jpath)]
        last = max((n for n in there if n.startswith("part-")), key=lambda n: int(re.match(r"part-(\d+)", n)[1]))
        if any(m and m[1] == folder and f.endswith("/" + last) for f, m in of.items()):
            out.append(folder)
    return out


def import_stream(spark: SparkSession, path: str, site_path: str, checkpoint: str, options: ImportOptions | None = None, available_now: bool = False):
    """A running query that imports arriving export files into a log of versions at ``site_path`` (see ``SiteLog``).

    A micro-batch makes the version of its number, from the one before it, and writes only what is new. Its manifest comes
    last: a batch that is run again after a failure starts from the same version, and files count once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        log = SiteLog(session, site_path)
        files = whole_exports(session, [r["path"] for r in batch.select("path").distinct().collect()])  # names of one micro-batch (maxFilesPerTrigger)
        known = log.versions()
        if files and number not in known:
            before = [v for v in known if v < number]
            result = import_exports(session, files, log.read(before[-1]) if before else SiteTables.empty(session), options)
            log.commit(result.added, number, result.replaced)

    return _run(_arriving(spark, path), handle, checkpoint, available_now)
