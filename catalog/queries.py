"""One Spark job per checked operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import documents, log_folder, log_lines, pages, quoted_lines, scan_logs, table
from veilframe.detectors import (
    CREDENTIALS,
    FILE_DIR,
    IPV4,
    IPV6,
    MAC_ADDR,
    Detector,
    addresses_first,
    loose_profile,
    paths_first,
    pick,
    strict_profile,
    with_detector,
)
from veilframe.functions.sql import register_functions
from veilframe.functions.tokens import TokenRule
from veilframe.operators.detection import detect, sensitive_rows
from veilframe.operators.dictionary import (
    rewrite_with_dictionary,
    token_collisions,
    token_dictionary,
)
from veilframe.operators.parts import ROW_ID, merge_rows, scrub_in_parts, split_rows
from veilframe.operators.ranking import rank_within
from veilframe.operators.rewriting import mask_kinds, scrub
from veilframe.operators.routing import coin_route, density_routes, size_route
from veilframe.operators.segments import (
    by_precedence,
    cleaned,
    counts_by_kind,
    distinct_segments,
    longest_first,
)
from veilframe.options import STRATEGIES, Options
from veilframe.plans.folder import run_folder
from veilframe.plans.strategies import pseudonymize
from veilframe.plans.summary import observed, run_summary, timed
from veilframe.shared import fresh_path
from veilframe.sources.sinks import placed, read_mirrored, replace_in_place, write_mirrored
from veilframe.sources.text import LINE_ORDER, opt_out, profile_files, profile_texts, quarantine

Query = Callable[[SparkSession, str], DataFrame]

STRICT, LOOSE, TOKENS = strict_profile(), loose_profile(), TokenRule()
CARD = Detector("CARD", r"\b[0-9]{16}\b", phase=1, rank=9)
FIVE = Detector("FIVE", r"\b[0-9]{5}\b", phase=3)
WORD = Detector("WORD", r"\b(?:IPV4|inet|seq)\b", phase=3)
SIX = Detector("SIX", r"[^ \n]{6}", phase=3)
HINT = "heartbeat"
NUM_PARTS = 3
MIN_SPLIT = 1000
MANY_PARTS = 2000


# --- sources and sinks -------------------------------------------------------


def _numbered(lines: DataFrame) -> DataFrame:
    """Scanned lines with their place in the file."""
    ranked = rank_within(lines, ["rel_path"], [F.col(c) for c in LINE_ORDER], "nth")
    return ranked.select(F.col("rel_path").alias("file"), "nth", F.col("value").alias("line"))


def a1_scan_text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(scan_logs(spark, log_folder(spark, log_lines(spark, sf_dir))))


def a1_rescan_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log lies in several part files; they are read as one file.

    Parts grow with the table, so that their number, which the driver lists
    and commits one by one, does not.
    """
    path = fresh_path(spark, "parts")
    lines = log_lines(spark, sf_dir)
    named = lines.withColumnRenamed("file", "rel_path")
    in_order = placed(named, ("line_no",)).sortWithinPartitions("rel_path", "line_no")
    parts = in_order.select("rel_path", "line").write.partitionBy("rel_path")
    parts.option("maxRecordsPerFile", max(7, lines.count() // MANY_PARTS)).text(path)
    return _numbered(scan_logs(spark, path))


def a2_opt_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = opt_out(log_lines(spark, sf_dir), "file", "line", ["line_no"], HINT)
    return kept


def a3_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 17th line gets a prefix that is no UTF-8, then goes through a file."""
    broken = F.concat(F.unhex(F.lit("FFFE")), F.col("line").cast("binary")).cast("string")
    lines = log_lines(spark, sf_dir).withColumn(
        "line", F.when(F.col("line_no") % 17 == 0, broken).otherwise(F.col("line"))
    )
    good, bad = quarantine(scan_logs(spark, log_folder(spark, lines)))
    both = good.select("file", F.lit(1).alias("good"), F.lit(0).alias("bad")).unionByName(
        bad.select("file", F.lit(0).alias("good"), F.lit(1).alias("bad"))
    )
    return both.groupBy("file").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))


def a3_quarantine_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreadable lines by file, from the folder that a run lists them in."""
    broken = F.concat(F.unhex(F.lit("FFFE")), F.col("line").cast("binary")).cast("string")
    lines = log_lines(spark, sf_dir).withColumn(
        "line", F.when(F.col("line_no") % 17 == 0, broken).otherwise(F.col("line"))
    )
    path, out = log_folder(spark, lines), fresh_path(spark, "masked")
    run = run_folder(spark, path, out, Options(strategy="IN_PLACE"))
    return run.quarantined.groupBy(F.col("rel_path").alias("file")).agg(F.count("*").alias("n_bad"))


def a4_profile_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_texts(documents(spark, sf_dir), "source", "text")


def a4_profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_texts(documents(spark, sf_dir), "doc_id", "text")


def a4_profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a written log folder; the parts of a log are added up."""
    profile = profile_files(scan_logs(spark, log_folder(spark, log_lines(spark, sf_dir))))
    return profile.select(F.col("rel_path").alias("file"), "n_bytes", "n_lines")


def a5_write_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = scrub(log_lines(spark, sf_dir), "line", STRICT, TOKENS)
    path = log_folder(spark, masked)
    return _numbered(read_mirrored(spark, path))


def a5_run_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run to a new folder, with its summary."""
    path, out = log_folder(spark, log_lines(spark, sf_dir)), fresh_path(spark, "masked")
    run_folder(spark, path, out, Options(strategy="IN_PLACE"))
    return _numbered(scan_logs(spark, out))


def a5_write_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = scrub(log_lines(spark, sf_dir), "line", STRICT, TOKENS)
    path = fresh_path(spark, "masked")
    named = masked.withColumnRenamed("file", "rel_path")
    write_mirrored(named, path, "line", ("line_no",), fmt="parquet")
    schema = "line_no bigint, value string, rel_path string"
    back = spark.read.schema(schema).parquet(path)
    return back.select(F.col("rel_path").alias("file"), "line_no", F.col("value").alias("line"))


def a6_replace_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = log_folder(spark, log_lines(spark, sf_dir))
    replace_in_place(spark, path, lambda lines: scrub(lines, "value", STRICT, TOKENS))
    return read_mirrored(spark, path).select(F.col("rel_path").alias("file"), F.col("value").alias("line"))


def a6_replace_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run in place finds the same files, with lines in order."""
    path = log_folder(spark, log_lines(spark, sf_dir))
    for _ in range(2):
        run_folder(spark, path, options=Options(strategy="IN_PLACE", remove_original=True))
    return _numbered(scan_logs(spark, path))


def a7_split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split_rows(table(spark, sf_dir, "documents"), "doc_id", "text", NUM_PARTS, MIN_SPLIT)
    return parts.drop(ROW_ID)


def a8_merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split_rows(table(spark, sf_dir, "documents"), "doc_id", "text", NUM_PARTS, MIN_SPLIT)
    return merge_rows(parts, "doc_id")


# --- detection ---------------------------------------------------------------


def b1_detect_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir), "doc_id", "text", pick(STRICT, IPV4))


def _on_lines(kind: str, profile: list[Detector]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detect(log_lines(spark, sf_dir), ["file", "line_no"], "line", pick(profile, kind))

    return query


def b5_detect_paths_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(pages(spark, sf_dir), "page_id", "url", pick(STRICT, FILE_DIR))


def b5_detect_paths_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(pages(spark, sf_dir), "page_id", "html", pick(STRICT, FILE_DIR))


def b6_detect_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir), "doc_id", "text", pick(STRICT, CREDENTIALS))


def b7_detect_all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir), "doc_id", "text", STRICT)


def b7_detect_all_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(log_lines(spark, sf_dir), ["file", "line_no"], "line", LOOSE)


def b8_sensitive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitive_rows(documents(spark, sf_dir), "text", STRICT).select("doc_id")


def b8_sensitive_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return sensitive_rows(turns, "text", STRICT).select("conv_id", "turn")


def b8_sensitive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitive_rows(log_lines(spark, sf_dir), "line", STRICT).select("file", "line_no")


# --- segments ----------------------------------------------------------------


def _log_segments(spark: SparkSession, sf_dir: str, keep_empty: bool = False) -> DataFrame:
    lines = log_lines(spark, sf_dir)
    return distinct_segments(lines, "file", "line", LOOSE, keep_empty=keep_empty)


def c1_distinct_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_segments(spark, sf_dir)


def c1_distinct_segments_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_segments(documents(spark, sf_dir), "source", "text", STRICT)


def c2_clean_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(_log_segments(spark, sf_dir))


def c2_clean_segments_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(distinct_segments(pages(spark, sf_dir), "page_id", "html", LOOSE))


def c2_clean_segments_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the lines end in quotes, which cleaning takes off."""
    return cleaned(distinct_segments(quoted_lines(spark, sf_dir), "file", "line", LOOSE))


def c3_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_first(cleaned(_log_segments(spark, sf_dir)), "file")


def c3_longest_first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = distinct_segments(documents(spark, sf_dir), "source", "text", LOOSE)
    return longest_first(cleaned(segments), "source")


def c4_segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_by_kind(_log_segments(spark, sf_dir, keep_empty=True), "file", LOOSE)


def c4_segment_counts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = distinct_segments(
        documents(spark, sf_dir), "doc_id", "text", STRICT, keep_empty=True
    )
    return counts_by_kind(segments, "doc_id", STRICT)


def c5_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_precedence(cleaned(_log_segments(spark, sf_dir)), "file", LOOSE)


# --- tokens and rewriting ----------------------------------------------------


def d1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(documents(spark, sf_dir), "doc_id", "text", STRICT)
    return found.withColumn("token", TOKENS.token_by(F.col("kind"), F.col("segment")))


def d1_tokens_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = TokenRule(salt="pepper", width=16, digest="sha256")
    found = detect(log_lines(spark, sf_dir), ["file", "line_no"], "line", pick(STRICT, IPV4))
    return found.withColumn("token", rule.token_by(F.col("kind"), F.col("segment")))


def d2_scrub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrub(documents(spark, sf_dir).select("doc_id", "text"), "text", STRICT, TOKENS)


def d2_scrub_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrub(log_lines(spark, sf_dir), "line", STRICT, TOKENS)


def d2_scrub_addresses_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrub(log_lines(spark, sf_dir), "line", addresses_first(STRICT), TOKENS)


def d2_scrub_paths_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrub(log_lines(spark, sf_dir), "line", paths_first(STRICT), TOKENS)


def d2_scrub_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrub(pages(spark, sf_dir), "html", STRICT, TOKENS)


def d3_dictionary_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite_with_dictionary(log_lines(spark, sf_dir), "file", "line", LOOSE, TOKENS)


def d3_dictionary_rewrite_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every dictionary over 100 entries on the substring join
    and no side small enough to broadcast."""
    return rewrite_with_dictionary(
        log_lines(spark, sf_dir),
        "file",
        "line",
        LOOSE,
        TOKENS,
        max_inline_entries=100,
        broadcast_limit=0,
    )


def d3_dictionary_rewrite_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return rewrite_with_dictionary(docs, "source", "text", LOOSE, TOKENS)


def d3_dictionary_rewrite_documents_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long cells, with every dictionary on the substring join."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return rewrite_with_dictionary(docs, "source", "text", LOOSE, TOKENS, max_inline_entries=1, broadcast_limit=0)


def d4_mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_kinds(documents(spark, sf_dir).select("doc_id", "text"), "text", LOOSE)


def d4_mask_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_kinds(log_lines(spark, sf_dir), "line", LOOSE)


def d5_token_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_dictionary(log_lines(spark, sf_dir), "file", "line", LOOSE, TOKENS)


def d5_token_dictionary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_dictionary(documents(spark, sf_dir), "doc_id", "text", STRICT, TOKENS)


def d6_token_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_collisions(d5_token_dictionary(spark, sf_dir))


# --- routing -----------------------------------------------------------------


def e1_density_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_routes(log_lines(spark, sf_dir), "file", "line", LOOSE, 200)


def e2_coin_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = log_lines(spark, sf_dir).select("file").distinct()
    return files.withColumn("route", coin_route("file", "1234"))


def e3_size_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", size_route(F.col("text"), MIN_SPLIT).alias("route"))


# --- strategies --------------------------------------------------------------


def _strategy(name: str) -> Query:
    options = Options(strategy=name, num_parts=NUM_PARTS, min_split_bytes=MIN_SPLIT)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pseudonymize(log_lines(spark, sf_dir), "file", "line", options)

    return query


def s2_sam_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return scrub_in_parts(docs, "text", STRICT, TOKENS, "text", NUM_PARTS, MIN_SPLIT)


def s3_sip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_documents(spark, sf_dir, "SIP")


def s6_hybrid_split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_documents(spark, sf_dir, "HYBRID_SPLIT")


def _split_documents(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    options = Options(strategy=strategy, num_parts=NUM_PARTS, min_split_bytes=MIN_SPLIT)
    return pseudonymize(docs, "doc_id", "text", options)


def s6_hybrid_split_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a run and the sink that the coin sent their file to."""
    path, out = log_folder(spark, log_lines(spark, sf_dir)), fresh_path(spark, "masked")
    run_folder(spark, path, out, Options(strategy="HYBRID_SPLIT"))
    schema = "value string, sink string, rel_path string"
    rows = spark.read.schema(schema).text(out)
    return rows.select("sink", F.col("rel_path").alias("file"), F.col("value").alias("line"))


def s5_hybrid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source, with a threshold that splits the sources over both routes."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return pseudonymize(docs, "source", "text", Options(threshold=5))


# --- run results, extensions -------------------------------------------------


def g1_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = Options(ignore_hint=HINT)
    return run_summary(log_lines(spark, sf_dir), "file", "line", ["line_no"], options)


def _summary(strategy: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = Options(strategy=strategy, ignore_hint=HINT)
        return run_summary(log_lines(spark, sf_dir), "file", "line", ["line_no"], options)

    return query


def g1_run_summary_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.unhex(F.lit("FFFE")), F.col("line").cast("binary")).cast("string")
    lines = log_lines(spark, sf_dir).withColumn(
        "line", F.when(F.col("line_no") % 17 == 0, broken).otherwise(F.col("line"))
    )
    return run_summary(lines, "file", "line", ["line_no"], Options(strategy="IN_PLACE"))


def g2_run_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times a masked write; the two counts were observed by that very job."""
    masked = pseudonymize(
        log_lines(spark, sf_dir), "file", "line", Options(strategy="IN_PLACE")
    )
    path = fresh_path(spark, "timed")
    timing = timed(lambda seen: observed(masked, "line", seen).write.parquet(path))
    back = spark.read.schema(masked.schema).parquet(path)
    return back.agg(
        F.count("*").alias("rows_written"),
        F.lit(timing.rows).alias("rows_observed"),
        F.lit(timing.text_bytes).alias("bytes_observed"),
        F.lit(timing.seconds > 0).alias("took_time"),
    )


def u1_custom_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return scrub(docs, "text", with_detector(STRICT, CARD), TOKENS)


def u1_custom_detector_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir), "doc_id", "text", with_detector(STRICT, CARD))


def u1_custom_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five digits are a kind of their own, but not those of a token."""
    return scrub(log_lines(spark, sf_dir), "line", with_detector(STRICT, FIVE), TOKENS)


def u1_custom_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six characters of any kind but blanks, and none of a token's."""
    return scrub(log_lines(spark, sf_dir), "line", with_detector(STRICT, SIX), TOKENS)


def u1_custom_negated_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_kinds(log_lines(spark, sf_dir), "line", with_detector(LOOSE, SIX))


def u1_custom_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(log_lines(spark, sf_dir), "file", "line", Options().with_kind(WORD))


def u1_custom_low_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = Options(strategy="LOW_LEVEL").with_kind(WORD)
    return pseudonymize(log_lines(spark, sf_dir), "file", "line", options)


def u2_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_functions(spark, STRICT, TOKENS)
    return spark.sql(
        "SELECT file, line_no, veil_scrub(line) AS line, veil_token('IPV4', file) AS file_token "
        "FROM {lines}",
        lines=log_lines(spark, sf_dir),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        a1_scan_text_corpus,
        a1_rescan_mirrored,
        a2_opt_out,
        a3_quarantine,
        a3_quarantine_sink,
        a4_profile_sources,
        a4_profile_documents,
        a4_profile_files,
        a5_write_mirrored,
        a5_run_folder,
        a5_write_parquet,
        a6_replace_in_place,
        a6_replace_twice,
        a7_split_parts,
        a8_merge_parts,
        b1_detect_ipv4,
        b5_detect_paths_urls,
        b5_detect_paths_html,
        b6_detect_credentials,
        b7_detect_all_documents,
        b7_detect_all_log_lines,
        b8_sensitive_documents,
        b8_sensitive_turns,
        b8_sensitive_lines,
        c1_distinct_segments,
        c1_distinct_segments_documents,
        c2_clean_segments,
        c2_clean_segments_pages,
        c2_clean_segments_quoted,
        c3_longest_first,
        c3_longest_first_documents,
        c4_segment_counts,
        c4_segment_counts_documents,
        c5_precedence,
        d1_tokens,
        d1_tokens_wide,
        d2_scrub_documents,
        d2_scrub_log_lines,
        d2_scrub_addresses_first,
        d2_scrub_paths_first,
        d2_scrub_pages,
        d3_dictionary_rewrite,
        d3_dictionary_rewrite_wide,
        d3_dictionary_rewrite_documents,
        d3_dictionary_rewrite_documents_wide,
        d4_mask_documents,
        d4_mask_log_lines,
        d5_token_dictionary,
        d5_token_dictionary_documents,
        d6_token_collisions,
        e1_density_routes,
        e2_coin_routes,
        e3_size_routes,
        s2_sam_documents,
        s3_sip_documents,
        s5_hybrid_documents,
        s6_hybrid_split_documents,
        s6_hybrid_split_sinks,
        g1_run_summary,
        g1_run_summary_quarantine,
        g2_run_timing,
        u1_custom_detector,
        u1_custom_detector_matches,
        u1_custom_digits,
        u1_custom_negated,
        u1_custom_negated_mask,
        u1_custom_hybrid,
        u1_custom_low_level,
        u2_sql_functions,
    )
}
QUERIES["b2_detect_ipv4_loose"] = _on_lines(IPV4, LOOSE)
QUERIES["b3_detect_ipv6"] = _on_lines(IPV6, LOOSE)
QUERIES["b4_detect_mac"] = _on_lines(MAC_ADDR, LOOSE)
QUERIES["b4_detect_mac_strict"] = _on_lines(MAC_ADDR, STRICT)
QUERIES["b5_detect_paths_log_lines"] = _on_lines(FILE_DIR, STRICT)
QUERIES["b6_detect_credentials_log_lines"] = _on_lines(CREDENTIALS, LOOSE)
QUERIES |= {f"s{n}_{name.lower()}": _strategy(name) for n, name in enumerate(STRATEGIES, 1)}
QUERIES |= {f"g1_run_summary_{name.lower()}": _summary(name) for name in ("IN_PLACE", "LOW_LEVEL", "RIPGREP")}
