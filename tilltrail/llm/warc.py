"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Reading cuts the bytes of an archive wherever the magic line that opens a record occurs, whether a
record begins there or a payload happens to hold it. Each task emits its candidates with the offset
at which, by its header, the next record must begin. From the start of each file these links are
followed by pointer jumping, and only candidates that are reached are records; bytes in between
belong to the record before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilltrail.llm.store import discard, stored, stored_at
from tilltrail.session import fresh_folder

# The record format.
MAGIC = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
HEADER_END = "\r\n\r\n"
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, HEX32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits at a time are four of the 32 letters."""
    hexed = F.sha1(payload)
    letters = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*letters), HEX32, BASE32)


# --- writing ------------------------------------------------------------------------------------


def _line(name: str, value: Column) -> Column:
    """A header line; without a value there is none. Line breaks and blanks in the value are escaped."""
    safe = F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def with_record_types(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Pages with ``payload``, ``payload_digest``, ``record_type`` and ``first_id``.

    Of equal payloads of at least ``smallest`` bytes the one with the least page_id is the response
    and the others revisit it; smaller ones are all responses. A repeated page (same id and payload)
    is a response each time; a page without an id is the response only where no page has one.
    Counting by digest and size, and joining on the digest, leaves both join sides an exchange
    of their own, so a payload that most pages share is split among tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("payload_digest", digest(F.col("payload").cast("binary")))
    size = F.octet_length("payload")
    large = rows.filter(size >= smallest)
    firsts = large.groupBy("payload_digest", size.alias("bytes")).agg(F.min("page_id").alias("first_id"))
    firsts = firsts.select(F.col("payload_digest").alias("_digest"), "first_id", F.lit(True).alias("_shared"))
    joined = rows.join(firsts, (rows["payload_digest"] == firsts["_digest"]) & (size >= smallest), "left")
    revisits = F.coalesce("_shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("record_type", F.when(revisits, REVISIT).otherwise(RESPONSE)).drop("_digest", "_shared")


def records(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """``value``: each page as a WARC record without its closing blank lines."""
    typed = with_record_types(pages, smallest)
    revisit = F.col("record_type") == REVISIT
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    identity = F.md5(F.concat_ws("|", page, "payload_digest", "record_type"))
    return typed.select(
        F.concat(
            F.lit(MAGIC),
            _line("WARC-Type", F.col("record_type")),
            _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), identity, F.lit(">"))),
            _line("WARC-Target-URI", F.col("url")),
            _line("WARC-Page-ID", F.col("page_id").cast("string")),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
            _line("WARC-Refers-To-Page-ID", F.when(revisit, F.col("first_id").cast("string"))),
            _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
            F.octet_length(block).cast("string"),
            F.lit(HEADER_END),
            block,
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, smallest: int = 0, compression: str = "gzip") -> None:
    """Write the archives, one file per task. Compressed files are read by one task each.

    The records follow from the join by digest, which splits a common payload, so files stay even.
    """
    writer = records(pages, smallest).write.option("lineSep", RECORD_END).option("compression", compression)
    writer.text(path)


# --- reading ------------------------------------------------------------------------------------


def _header(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between occurrences of the magic: ``file`` (a hash of its path), ``block``, ``row``, the bytes."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Each occurrence of the magic: where it is, what its header says, where the next record must begin.

    ``offset`` counts the bytes before it in the (unpacked) file: those of earlier blocks, from a sum
    per block, and of earlier rows of its block. ``next`` is null if there is no proper header.
    ``whole`` says that the record's content ends before the next occurrence. The second table has the
    bytes by ``file``, ``block`` and ``row``: they are stored with the row's number, which another read may
    number differently.
    """
    pieces = _pieces(spark, path)
    # Latin letters only stand in a header's names; its values are measured in bytes.
    head = F.substring_index("value", HEADER_END, 1)
    parsed = pieces.select("file", "block", "row", "value", head.alias("head"))
    length = _header("Content-Length").try_cast("long")
    has_end = F.col("value").contains(HEADER_END)
    sized = parsed.select(
        "file",
        "block",
        "row",
        F.octet_length("value").cast("long").alias("bytes"),
        (F.octet_length("head") + len(HEADER_END)).cast("long").alias("head_bytes"),
        F.when(has_end & (length >= 0), length).alias("content_bytes"),
        *[
            _header(name).alias(column)
            for column, name in (
                ("record_type", "WARC-Type"),
                ("url", "WARC-Target-URI"),
                ("page_id", "WARC-Page-ID"),
                ("refers_to", "WARC-Refers-To-Page-ID"),
                ("declared_digest", "WARC-Payload-Digest"),
            )
        ],
        "value",
    )
    content = F.expr("substring(cast(value AS binary), cast(head_bytes + 1 AS int), cast(content_bytes AS int))")
    whole = F.coalesce(F.col("content_bytes") + F.col("head_bytes") <= F.col("bytes"), F.lit(False))
    thin = sized.withColumns({"whole": whole, "payload_digest": F.when(whole, digest(content))})
    pieces = stored(thin, "warc-pieces")
    thin = pieces.drop("value")
    step = F.col("bytes") + len(MAGIC)
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = thin.groupBy("file", "block").agg(F.sum(step).alias("_bytes"))
    starts = blocks.select("file", "block", F.coalesce(F.sum("_bytes").over(order), F.lit(0)).alias("_start"))
    within = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = thin.withColumn("_before", F.coalesce(F.sum(step).over(within), F.lit(0)))
    # A row begins behind the magic that opens it, so its record begins that much earlier.
    offset = F.col("_start") + F.col("_before") - len(MAGIC)
    located = placed.join(starts, ["file", "block"]).withColumn("offset", offset).drop("_start", "_before")
    after = F.col("offset") + len(MAGIC) + F.col("head_bytes") + F.col("content_bytes") + len(RECORD_END)
    return located.filter("offset >= 0").withColumn("next", after), pieces.select("file", "block", "row", "value")


def reached(links: DataFrame) -> DataFrame:
    """``file`` and ``offset`` of what can be reached from offset 0 over ``offset`` -> ``next``.

    Pointer jumping: each round all links of a file become twice as long, and what they lead to from
    offsets already reached is reached as well. The number of rounds is the logarithm of the
    longest chain. Links that lead out of the file drop out; each round is stored.
    """
    spark = links.sparkSession
    jumps, jumps_path = stored_at(links.filter("next > offset").select("file", "offset", "next"), "warc-jumps")
    found, found_path = stored_at(links.filter("offset = 0").select("file", "offset"), "warc-reached")
    count, before = found.count(), 0
    while count > before:
        led = found.join(jumps, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        more, more_path = stored_at(found.unionByName(led).distinct(), "warc-reached")
        onward = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("_then"))
        longer = jumps.join(onward, ["file", "next"]).select("file", "offset", F.col("_then").alias("next"))
        longer, longer_path = stored_at(longer, "warc-jumps")
        for path in (jumps_path, found_path):
            discard(spark, path)
        jumps, jumps_path, found, found_path = longer, longer_path, more, more_path
        count, before = found.count(), count
    return found


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under a path: place, header values, ``content_bytes`` and ``payload_digest``.

    ``payload_digest`` is computed from the content as read. Content that holds the magic is put
    together from its pieces, which were stored when the archives were read; they are read once. A record whose content is cut off by the end of its file is none.
    """
    found_in_files, pieces_read = candidates(spark, path)
    all_found = stored(found_in_files, "warc-candidates")
    kept = stored(all_found.join(reached(all_found), ["file", "offset"]), "warc-records")
    whole = kept.filter("whole").drop("whole")
    parted = kept.filter("NOT whole AND content_bytes IS NOT NULL")
    if parted.isEmpty():
        return whole
    # Of each file the candidates in order: those not reached belong to the record before them.
    marks = all_found.join(kept.select("file", "offset", F.lit(True).alias("_kept")), ["file", "offset"], "left")
    order = Window.partitionBy("file").orderBy("offset")
    owner = F.last(F.when(F.col("_kept"), F.col("offset")), ignorenulls=True).over(order)
    owned = marks.select("file", "block", "row", "offset", owner.alias("owner"))
    needed = owned.join(parted.select("file", F.col("offset").alias("owner")), ["file", "owner"])
    found = pieces_read.join(needed, ["file", "block", "row"])
    pieces = F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("pieces")
    joined = found.groupBy("file", "owner").agg(pieces)
    text = F.array_join(F.col("pieces.value"), MAGIC)
    contents = joined.select("file", F.col("owner").alias("offset"), text.alias("_value"))
    rebuilt = parted.drop("whole", "payload_digest").join(contents, ["file", "offset"])
    content = F.expr("substring(cast(_value AS binary), cast(head_bytes + 1 AS int), cast(content_bytes AS int))")
    complete = F.octet_length("_value") >= F.col("head_bytes") + F.col("content_bytes")
    rebuilt = rebuilt.filter(complete).withColumn("payload_digest", digest(content)).drop("_value")
    return whole.unionByName(rebuilt.select(*whole.columns))


def archive_round_trip(pages: DataFrame, smallest: int = 0, compression: str = "gzip") -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` of every page.

    The pages are written as archives and everything is read back from them: a response's size
    and digest from its content, a revisit's from the response it refers to. Null and empty
    html are empty payloads. No pages give no records. Other columns of the pages are not read, whatever their names. Each call
    has archives of its own, which go once they are read.
    """
    spark = pages.sparkSession
    path = fresh_folder(spark, "warc-archives")
    write_archives(pages, path, smallest, compression)
    back = stored(read_records(spark, path), "warc-read")
    discard(spark, path)
    own = back.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("content_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        F.substring_index("declared_digest", ":", -1).alias("declared"),
    )
    responses = own.filter(F.col("record_type") == RESPONSE)
    # Digest and size in the grouping, the digest in the join: each side keeps its own exchange.
    first = responses.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("_first"))
    first = first.select(F.col("payload_digest").alias("declared"), "payload_digest", "payload_bytes", "_first")
    revisits = own.filter(F.col("record_type") == REVISIT).drop("payload_bytes", "payload_digest")
    same = (revisits["declared"] == first["declared"]) & revisits["refers_to"].eqNullSafe(first["_first"])
    revisits = revisits.join(first, same)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*names).unionByName(revisits.select(*names))
