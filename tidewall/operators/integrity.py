"""Chunks, manifests, hash chains, completeness and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.functions.ordered import next_after, reached, time_bucket, with_previous, with_running_sum
from tidewall.functions.rows import position_rows
from tidewall.session import cut_lineage

CHUNKS_PER_BUCKET = 1024
FANOUT = 256  # nodes under one node of a hash tree


def content_hash(col: Column, algo: str = "sha256") -> Column:
    """MD5, SHA-256 or SHA-512 of text or bytes, in hex."""
    if algo == "md5":
        return F.md5(col)
    bits = {"sha256": 256, "sha512": 512}
    if algo not in bits:
        raise ValueError("algo must be md5, sha256 or sha512")
    return F.sha2(col, bits[algo])


def chunk(df: DataFrame, key: str, col: str, size: int) -> DataFrame:
    """Fixed-size chunks of a content column: index, data, size in bytes and MD5.

    Text is cut by one pass of a regex, whose cost is the length of the text; binary content by
    byte ranges.
    """
    if dict(df.dtypes)[col] == "binary":
        n = F.octet_length(col)
        last = F.greatest(F.ceil(n / size) - 1, F.lit(0))
        pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: F.substring(F.col(col), (i * size + 1).cast("int"), F.lit(size)))
    else:
        found = F.regexp_extract_all(F.col(col), F.lit(r"(?s).{1,%d}" % size), F.lit(0))
        pieces = F.when(F.length(col) > 0, found).otherwise(F.array(F.lit("")))
    exploded = position_rows(df.where(F.col(col).isNotNull()), [key], pieces, "chunk_index", "data")
    return exploded.select(
        key,
        F.col("chunk_index").cast("bigint"),
        "data",
        F.octet_length("data").cast("bigint").alias("chunk_size"),
        F.md5("data").alias("chunk_md5"),
    )


def manifest(chunks: DataFrame, key: str) -> DataFrame:
    """One row per file: chunk count, total size and a digest over its (index, hash) pairs.

    The digest adds 64-bit hashes, so it needs no order and no list. ``manifest_pages`` has the list.
    """
    pair = F.xxhash64("chunk_index", "chunk_md5").cast("decimal(38,0)")
    return chunks.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.sum("chunk_size").alias("total_size"),
        F.sum(pair).cast("string").alias("digest"),
    )


def manifest_pages(chunks: DataFrame, key: str, page_size: int = CHUNKS_PER_BUCKET) -> DataFrame:
    """The chunk list of each file in pages of fixed length, so a huge file is many small rows."""
    page = F.floor(F.col("chunk_index") / page_size).cast("bigint")
    listed = F.array_sort(F.collect_set(F.struct("chunk_index", "chunk_md5")))
    return chunks.groupBy(key, page.alias("page")).agg(
        F.count_distinct("chunk_index").alias("chunks"), F.transform(listed, lambda c: c["chunk_md5"]).alias("chunk_list")
    )


def envelopes(chunks: DataFrame, key: str, linked: bool = True) -> DataFrame:
    """Seal every chunk: data hash, nonce, hash of the chunk before, and a hash over all of them.

    A chunk needs only its predecessor's hash, so files are cut into runs of chunks and one huge
    file does not become one task. The nonce is the chunk's number within its file.
    """
    hashed = chunks.withColumn("data_hash", F.sha2("data", 256))
    bucket = F.floor(F.col("chunk_index") / CHUNKS_PER_BUCKET).cast("bigint")
    if linked:
        hashed = with_previous(hashed, [key], ["chunk_index"], {"previous_chunk_hash": "data_hash"}, bucket)
    else:
        hashed = hashed.withColumn("previous_chunk_hash", F.lit(None).cast("string"))
    return hashed.withColumn("sequence_nonce", F.col("chunk_index") + 1).withColumn(
        "envelope_hash", seal(F.col("chunk_index"), F.col("data_hash"), F.col("sequence_nonce"), F.col("previous_chunk_hash"))
    )


def seal(index: Column, data_hash: Column, nonce: Column, previous: Column) -> Column:
    """Hash over the envelope fields in JSON; a missing link is left out."""
    return F.sha2(
        F.to_json(
            F.struct(
                index.alias("chunk_index"),
                data_hash.alias("data_hash"),
                nonce.alias("sequence_nonce"),
                previous.alias("previous_chunk_hash"),
            )
        ),
        256,
    )


def verify_envelopes(df: DataFrame, linked: bool = True) -> DataFrame:
    """First failing reason per envelope, or 'ok'."""
    checks = [
        (F.sha2("data", 256) != F.col("data_hash"), "data_hash"),
        (seal(F.col("chunk_index"), F.col("data_hash"), F.col("sequence_nonce"), F.col("previous_chunk_hash")) != F.col("envelope_hash"), "envelope_hash"),
        ((F.col("sequence_nonce") == 0) & (F.col("chunk_index") > 0), "nonce"),
    ]
    if linked:
        checks.append((F.col("previous_chunk_hash").isNull() & (F.col("chunk_index") > 0), "missing_link"))
    out = F.lit("ok")
    for test, name in reversed(checks):
        out = F.when(F.coalesce(test, F.lit(True)), F.lit(name)).otherwise(out)
    return df.withColumn("verdict", out)


def verify_chunks(chunks: DataFrame, sealed: DataFrame, key: str, zero_tolerance: bool = True) -> DataFrame:
    """Per chunk: corrupt when the hash differs, or when it is empty under zero tolerance."""
    expected = sealed.select(key, "chunk_index", F.col("data_hash").alias("expected_hash"))
    joined = chunks.join(expected, [key, "chunk_index"])
    bad = F.sha2("data", 256) != F.col("expected_hash")
    if zero_tolerance:
        bad = bad | (F.octet_length("data") == 0)
    return joined.select(key, "chunk_index", F.coalesce(bad, F.lit(True)).alias("corrupt"))


def corrupt_summary(verified: DataFrame, key: str) -> DataFrame:
    """Chunks, corrupt chunks and the first corrupt index per file; the indices are the corrupt rows."""
    return verified.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if("corrupt").alias("corrupt_chunks"),
        F.coalesce(F.min(F.when(F.col("corrupt"), F.col("chunk_index"))), F.lit(-1)).alias("first_corrupt"),
    )


def missing_chunks(chunks: DataFrame, expected: DataFrame, key: str, count: str = "expected_count", mode: str = "gaps") -> DataFrame:
    """One row per missing chunk.

    ``gaps`` finds every absent index. ``tail`` assumes the received chunks are the first ones and
    reports from their number on.
    """
    if mode == "tail":
        got = chunks.groupBy(key).agg(F.count_distinct("chunk_index").alias("got"))
        return (
            expected.join(got, key, "left")
            .where(F.coalesce("got", F.lit(0)) < F.col(count))
            .select(key, F.explode(F.sequence(F.coalesce("got", F.lit(0)).cast("bigint"), F.col(count).cast("bigint") - 1)).alias("chunk_index"))
        )
    if mode != "gaps":
        raise ValueError("mode must be gaps or tail")
    # a declared count may be huge: its blocks of 1,024 are dealt out before they are expanded
    last = F.col(count).cast("bigint") - 1
    blocks = expected.where(F.col(count) > 0).select(key, last.alias("__last"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / 1024))).alias("__block"))
    first = F.col("__block") * 1024
    wanted = blocks.repartition(key, "__block").select(
        key, F.explode(F.sequence(first, F.least(first + 1023, F.col("__last")))).alias("chunk_index")
    )
    return wanted.join(chunks.select(key, F.col("chunk_index").cast("bigint")), [key, "chunk_index"], "left_anti")


def complete_files(chunks: DataFrame, expected: DataFrame, key: str, count: str = "expected_count") -> DataFrame:
    """Received count per file and whether it is complete."""
    got = chunks.groupBy(key).agg(F.count_distinct("chunk_index").alias("received"))
    return expected.join(got, key, "left").select(
        key,
        F.coalesce("received", F.lit(0)).alias("received"),
        (F.coalesce("received", F.lit(0)) >= F.col(count)).alias("complete"),
    )


def reassemble(
    chunks: DataFrame, files: DataFrame, key: str, file_hash: str = "file_md5", max_bytes: int = 512 * 1024 * 1024
) -> DataFrame:
    """Content of each file from its chunks in order, checked against the file's hash.

    A file is gathered only when it fits a cell: repeats of a chunk are dropped and sizes added up
    first. A larger file comes back as too_large without content; ``verified_pages`` checks files of any size
    against the root of their hash tree and hands on their pages.
    """
    once = chunks.groupBy(key, "chunk_index").agg(F.min("data").alias("data"))
    sizes = once.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunk_count"), F.sum(F.octet_length("data")).alias("total_size")
    )
    fits = sizes.where(F.col("total_size") <= max_bytes).select(key)
    parts = once.join(fits, key, "left_semi").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "data"))).alias("__parts")
    )
    whole = parts.select(key, F.array_join(F.transform("__parts", lambda p: p["data"]), "").alias("content"))
    known = sizes.join(files.select(key, file_hash), key).join(whole, key, "left")
    return known.select(
        key,
        "chunk_count",
        "content",
        F.when(F.col("content").isNull(), F.lit("too_large"))
        .when(F.md5("content") == F.col(file_hash), F.lit("ok"))
        .otherwise(F.lit("hash_mismatch"))
        .alias("status"),
    )


def _pages_once(chunks: DataFrame, key: str, data: str, fanout: int) -> DataFrame:
    """Pages without their repeats (key, __node, __i, __d); a node holds ``fanout`` neighbouring places."""
    placed = chunks.select(key, F.col("chunk_index").cast("bigint").alias("__i"), F.col(data).alias("__d"))
    return placed.withColumn("__node", F.floor(F.col("__i") / fanout).cast("bigint")).groupBy(key, "__node", "__i").agg(F.min("__d").alias("__d"))


def _lowest_nodes(once: DataFrame, key: str) -> DataFrame:
    """The nodes right above the pages: first leaf, hash of all leaves, number and bytes of the pages, last place. Leaves are written nowhere."""
    leaf = F.sha2(F.concat_ws(":", "__i", F.sha2(F.col("__d"), 256)), 256)
    leaves = once.select(key, "__node", "__i", leaf.alias("__h"), F.octet_length("__d").cast("bigint").alias("__size"))
    under = F.array_sort(F.collect_list(F.struct("__i", "__h")))
    nodes = leaves.groupBy(key, "__node").agg(under.alias("__u"), F.count(F.lit(1)).alias("__pages"), F.sum("__size").alias("__size"), F.max("__i").alias("__last"))
    joint = F.sha2(F.array_join(F.transform("__u", lambda x: x["__h"]), ""), 256)
    return cut_lineage(nodes.select(key, "__node", F.col("__u")[0]["__h"].alias("__first"), joint.alias("__joint"), "__pages", "__size", "__last"))


def _roots(nodes: DataFrame, key: str, fanout: int) -> DataFrame:
    sizes = cut_lineage(nodes.groupBy(key).agg(F.sum("__pages").alias("pages"), F.sum("__size").alias("total_size"), (F.max("__last") + 1).alias("__n")))
    level = nodes.join(sizes.select(key, "__n"), key).select(
        key, F.col("__node").alias("__i"), F.when(F.col("__n") == 1, F.col("__first")).otherwise(F.col("__joint")).alias("__h"),
        F.ceil(F.col("__n") / fanout).cast("bigint").alias("__left"),
    )
    most = -(-(sizes.agg(F.max("__n")).first()[0] or 0) // fanout)
    while most > 1:
        under = F.array_sort(F.collect_list(F.struct("__i", "__h")))
        above = level.groupBy(key, F.floor(F.col("__i") / fanout).cast("bigint").alias("__i")).agg(under.alias("__u"), F.min("__left").alias("__left"))
        joint = F.sha2(F.array_join(F.transform("__u", lambda x: x["__h"]), ""), 256)
        level = above.select(
            key, "__i", F.when(F.col("__left") == 1, F.col("__u")[0]["__h"]).otherwise(joint).alias("__h"),
            F.ceil(F.col("__left") / fanout).cast("bigint").alias("__left"),
        )
        most = -(-most // fanout)
    return sizes.drop("__n").join(level.select(key, F.col("__h").alias("root")), key)


def merkle_roots(chunks: DataFrame, key: str, data: str = "data", fanout: int = FANOUT) -> DataFrame:
    """One row per file: pages, total_size and the root of its hash tree.

    A leaf is the SHA-256 of a page's place and of its own SHA-256, so pages that are changed, moved, lost or added give another root. A
    node is the SHA-256 of the hashes under it in order, ``fanout`` at most, and a single node is the root: no task holds more of a
    file than that, whatever its size. Repeats of a page count once, the least one; places count from 0 and may miss some. No
    chunks give no rows. Chunks that are dealt out by ``key`` already are not moved again.
    """
    return _roots(_lowest_nodes(_pages_once(chunks, key, data, fanout), key), key, fanout)


def verified_pages(chunks: DataFrame, files: DataFrame, key: str, root: str = "root", data: str = "data", fanout: int = FANOUT) -> DataFrame:
    """The pages of every file of ``files`` (key and expected root), each with the byte it starts at and the file's status: ok or hash_mismatch.

    The content of a file is its pages by chunk_index; nothing is gathered, so files of any size are checked and handed on. Repeats of
    a page count once; files without a page give no row. Only the lowest nodes of the trees are written down and summed over a file; a page
    takes the start of its node from there.
    """
    once = _pages_once(chunks, key, data, fanout)
    nodes = _lowest_nodes(once, key)
    roots = _roots(nodes, key, fanout).select(key, F.col("root").alias("__root"))
    status = files.select(key, F.col(root).alias("__want")).join(roots, key).select(key, F.when(F.col("__root") == F.col("__want"), F.lit("ok")).otherwise(F.lit("hash_mismatch")).alias("status"))
    bucket = F.floor(F.col("__node") / CHUNKS_PER_BUCKET).cast("bigint")
    summed = with_running_sum(nodes.select(key, "__node", "__size"), [key], ["__node"], F.col("__size"), "__end", bucket)
    starts = summed.select(key, "__node", (F.col("__end") - F.col("__size")).alias("__base")).join(status, key)
    size = F.octet_length("__d").cast("bigint")
    within = once.withColumn("__before", F.sum(size).over(Window.partitionBy(key, "__node").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)) - size)
    return within.join(starts, [key, "__node"]).select(
        key, F.col("__i").alias("chunk_index"), (F.col("__base") + F.col("__before")).alias("start"), F.col("__d").alias(data), "status"
    )


def chunk_mismatch(df: DataFrame, data: str = "data", expected: str = "expected_md5") -> DataFrame:
    """Arriving chunks whose MD5 is not the announced one."""
    return df.withColumn("actual_md5", F.md5(data)).where(F.col("actual_md5") != F.col(expected))


def session_progress(acks: DataFrame, sessions: DataFrame, session: str, count: str = "expected_count") -> DataFrame:
    """Confirmed and pending counts per session and whether it is complete.

    Repeated acknowledgements collapse before the count. The pending chunks themselves are the rows
    of ``missing_chunks``.
    """
    once = acks.select(session, F.col("chunk_index").cast("bigint").alias("chunk_index")).distinct()
    got = once.join(sessions.select(session, F.col(count).alias("__n")), session).where(
        (F.col("chunk_index") >= 0) & (F.col("chunk_index") < F.col("__n"))
    )
    seen = got.groupBy(session).agg(F.count(F.lit(1)).alias("confirmed"))
    joined = sessions.join(seen, session, "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(0).cast("bigint")))
    return joined.select(
        session,
        "confirmed",
        (F.col(count).cast("bigint") - F.col("confirmed")).alias("pending"),
        (F.col("confirmed") >= F.col(count)).alias("complete"),
    )


def expired_sessions(events: DataFrame, session: str, ts: str, max_age_seconds: int, now: Column) -> DataFrame:
    """Sessions whose last activity is older than the age."""
    idle = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp"))
    return (
        events.groupBy(session)
        .agg(F.max(ts).alias("last_seen"))
        .withColumn("idle_seconds", idle)
        .where(F.col("idle_seconds") > max_age_seconds)
    )


def repair_progress(df: DataFrame, session: str, ok: str = "ok") -> DataFrame:
    """Requested and failed chunks and the success rate per session."""
    return df.groupBy(session).agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed"),
        (F.count_if(F.col(ok)) / F.count(F.lit(1))).alias("success_rate"),
    )


def repair_totals(df: DataFrame, ok: str = "ok") -> DataFrame:
    """The same over all rows; the rate is 1 when nothing was requested."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("requested"),
        F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed"),
        F.when(n == 0, F.lit(1.0)).otherwise(F.count_if(F.col(ok)) / F.greatest(n, F.lit(1))).alias("success_rate"),
    )


def backoff(df: DataFrame, key: str, attempts: str, cap: int = 30) -> DataFrame:
    """Retry schedule: wait 2^(n−1) seconds, at most ``cap``, before attempt n, and the wait so far."""
    n = F.col(attempts).cast("int")
    waits = F.transform(F.sequence(F.lit(1), n), lambda i: F.least(F.pow(F.lit(2.0), i - 1), F.lit(float(cap))).cast("bigint"))
    rows = df.where(n > 0).withColumn("__waits", waits).select(key, "__waits", F.posexplode("__waits").alias("__i", "wait_seconds"))
    total = F.aggregate(F.slice("__waits", F.lit(1), F.col("__i") + 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(key, (F.col("__i") + 1).cast("bigint").alias("attempt"), "wait_seconds", total.alias("elapsed_seconds"))


def hash_changed(df: DataFrame, original: str, sanitized: str) -> DataFrame:
    """Whether the sanitised content differs from the original."""
    return df.withColumns(
        {
            "original_hash": F.sha2(original, 256),
            "sanitized_hash": F.sha2(sanitized, 256),
            "changed": F.sha2(original, 256) != F.sha2(sanitized, 256),
        }
    )


def replays(events: DataFrame, keys: list[str], ts: str, order: list[str], ttl_seconds: int, bucket_seconds: int = 3600) -> DataFrame:
    """Rows whose key was seen within the TTL before (strict form: against the previous sighting)."""
    prev = with_previous(events, keys, order, {"previous_ts": ts}, time_bucket(F.col(ts), bucket_seconds))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("previous_ts").cast("timestamp"))
    return prev.where(gap < ttl_seconds * 1_000_000)


def replays_since_accepted(events: DataFrame, keys: list[str], ts: str, order: list[str], ttl_seconds: int, bucket_seconds: int = 86400) -> DataFrame:
    """Adds is_replay (exact form): the TTL runs from the last sighting that was none.

    The sightings accepted are those reached from a key's first one, each by a jump to the first that lies a TTL later; jumps
    are doubled, so one key may hold all rows. A null key is a key of its own; a row without a time is no replay and accepts nothing.
    """
    rows = cut_lineage(events.withColumn("__id", F.monotonically_increasing_id()))
    timed = rows.where(F.col(ts).isNotNull())
    jumps = next_after(timed, keys, order, ts, "__id", ttl_seconds, max(bucket_seconds, ttl_seconds))
    starts = timed.groupBy(*keys).agg(F.min_by("__id", F.struct(*order)).alias("at"))
    accepted = reached(jumps.select(F.col("__id").alias("at"), F.col("next_id").alias("to")), starts)
    marked = rows.join(accepted.select(F.col("at").alias("__id"), F.lit(False).alias("__new")), "__id", "left")
    return marked.select(*events.columns, F.coalesce("__new", F.col(ts).isNotNull()).alias("is_replay"))
