"""The same results in DuckDB SQL, over the same pattern strings."""

from __future__ import annotations

from catalog.inputs import LOG_LINES_SQL
from catalog.queries import CARD, FIVE, HINT, LOOSE, MIN_SPLIT, NUM_PARTS, SIX, STRICT, WORD
from veilframe.detectors import (
    CREDENTIALS,
    FILE_DIR,
    IPV4,
    IPV6,
    MAC_ADDR,
    Detector,
    addresses_first,
    in_order,
    paths_first,
    pick,
    with_detector,
)
from veilframe.operators.segments import count_column
from veilframe.sources.text import OPT_OUT_MARKER

LL = "log_lines AS (" + LOG_LINES_SQL.format(events="events") + ")"
_BLANKS = r"[ \t\r\n\f\x0b]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _token(kind: str, segment: str) -> str:
    """Token of a segment; ``kind`` and ``segment`` are SQL expressions."""
    inner = f"left(md5(lower({kind}) || '1234'), 5)"
    return f"('{{{{' || {kind} || '-' || left(md5({inner} || {segment}), 5) || '}}}}')"


def _mac_token(kind: str, segment: str, salt: str, width: int) -> str:
    """The same by HMAC-SHA-256, for a salt of 64 bytes at most."""
    pad = lambda byte: "unhex('" + bytes(b ^ byte for b in salt.encode().ljust(64, b"\0")).hex() + "')"
    inner = f"sha256({pad(0x36)} || encode(lower({kind}) || ':' || {segment}))"
    return f"('{{{{' || {kind} || '-' || left(sha256({pad(0x5C)} || unhex({inner})), {width}) || '}}}}')"


def _priority(detectors: list[Detector], kind: str = "kind") -> str:
    return "CASE " + " ".join(f"WHEN {kind} = {_q(d.kind)} THEN {d.priority}" for d in detectors) + " END"


def _found(source: str, keys: str, col: str, detectors: list[Detector]) -> str:
    """All matches, with position: one branch per kind."""
    return " UNION ALL ".join(
        f"SELECT {keys}, {_q(d.kind)} AS kind, CAST(unnest(range(len(m))) AS INTEGER) AS pos, "
        f"unnest(m) AS segment FROM (SELECT {keys}, regexp_extract_all({col}, {_q(d.regex)}, 0) AS m "
        f"FROM {source})"
        for d in detectors
    )


def _distinct(source: str, keys: str, col: str, detectors: list[Detector]) -> str:
    return f"SELECT DISTINCT {keys}, kind, segment FROM ({_found(source, keys, col, detectors)})"


def _cleaned(segments: str, keys: str) -> str:
    trimmed = f"regexp_replace(regexp_replace(segment, '''+$', ''), '^{_BLANKS}|{_BLANKS}$', '', 'g')"
    return (
        f"SELECT DISTINCT {keys}, kind, segment FROM (SELECT {keys}, kind, {trimmed} AS segment "
        f"FROM ({segments})) WHERE segment <> ''"
    )


# A finished token or label, as it stands in the text.
_DONE = r"\{\{[A-Z0-9-]+\}\}|\{\{[A-Z0-9-]+-[0-9a-f]{5}\}\}"


def _zipped(text: str, rx: str, piece: str, var: str) -> str:
    """The text cut at the matches of a pattern; ``piece`` is SQL for one gap
    and the match behind it, ``var[1]`` and ``var[2]``."""
    cut = f"list_zip(string_split_regex({text}, {_q(rx)}), regexp_extract_all({text}, {_q(rx)}, 0))"
    return f"array_to_string(list_transform({cut}, lambda {var}: {piece}), '')"


def _outside_tokens(text: str, d: Detector, new: str) -> str:
    """The text with matches (``m[2]``) replaced where no token stands.  Only a
    value of CREDENTIALS, up to a blank, takes tokens in."""
    kind_piece = f"m[1] || coalesce({new}, '')"
    if d.kind == CREDENTIALS:
        return _zipped(text, d.regex, kind_piece, "m")
    return _zipped(text, _DONE, _zipped("g[1]", d.regex, kind_piece, "m") + " || coalesce(g[2], '')", "g")


def _scrub_steps(source: str, keys: str, col: str, detectors: list[Detector]) -> tuple[str, str]:
    """CTEs that scrub kind after kind, and the name of the last one."""
    steps, current = [], source
    for i, d in enumerate(in_order(detectors)):
        text = f"CASE WHEN {col} IS NULL THEN NULL ELSE {_outside_tokens(col, d, _token(_q(d.kind), 'm[2]'))} END"
        steps.append(f"scrub{i} AS (SELECT {keys}, {text} AS {col} FROM {current})")
        current = f"scrub{i}"
    return ", ".join(steps), current


def _scrub(source: str, keys: str, col: str, detectors: list[Detector], before: str = "") -> str:
    steps, last = _scrub_steps(source, keys, col, detectors)
    return f"WITH {before + ', ' if before else ''}{steps} SELECT {keys}, {col} FROM {last}"


def _mask(source: str, keys: str, col: str, detectors: list[Detector]) -> str:
    for d in in_order(detectors):
        label = f"CASE WHEN m[2] IS NOT NULL THEN {_q('{{' + d.kind + '}}')} END"
        text = f"CASE WHEN {col} IS NULL THEN NULL ELSE {_outside_tokens(col, d, label)} END"
        source = f"(SELECT {keys}, {text} AS {col} FROM {source})"
    return f"SELECT {keys}, {col} FROM {source}"


def _entries(source: str, key: str, col: str, detectors: list[Detector], where: str = "TRUE") -> str:
    """One ordered list of ``segment‖chr(1)‖token`` per key."""
    segments = _cleaned(_distinct(source, key, col, detectors), key)
    return (
        f"SELECT {key}, list(segment || chr(1) || {_token('kind', 'segment')} "
        f"ORDER BY {_priority(detectors)}, -length(segment), segment) AS entries "
        f"FROM ({segments}) WHERE {where} GROUP BY {key}"
    )


def _fold(col: str) -> str:
    """Entries replaced in the gaps between finished tokens, which the list
    holds at its even places."""
    segment, token = "split_part(e, chr(1), 1)", "split_part(e, chr(1), 2)"
    held = f"list_filter(entries, lambda e: contains({col}, {segment}))"
    # chr(2) stands around each finished token: pieces alternate.
    once = (
        f"array_to_string(list_transform(string_split(text, chr(2)), lambda p, n: "
        f"CASE WHEN n % 2 = 1 THEN replace(p, {segment}, chr(2) || {token} || chr(2)) ELSE p END), chr(2))"
    )
    return (
        f"CASE WHEN entries IS NULL THEN {col} ELSE "
        f"replace(list_reduce(list_prepend({col}, {held}), lambda text, e: {once}), chr(2), '') END"
    )


def _dictionary_rewrite(
    source: str, key: str, rest: str, col: str, before: str = "", loose: list[Detector] = LOOSE
) -> str:
    return (
        f"WITH {before + ', ' if before else ''}dict AS ({_entries(source, key, col, loose)}) "
        f"SELECT l.{key}, {rest}, {_fold(col)} AS {col} FROM {source} l "
        f"LEFT JOIN dict ON l.{key} = dict.{key}"
    )


def _counts(source: str, key: str, col: str, detectors: list[Detector]) -> str:
    per_kind = ", ".join(
        f"count(segment) FILTER (WHERE kind = {_q(d.kind)}) AS {count_column(d.kind)}" for d in detectors
    )
    return (
        f"SELECT k.{key}, {per_kind}, count(segment) AS total_segments "
        f"FROM (SELECT DISTINCT {key} FROM {source}) k "
        f"LEFT JOIN ({_distinct(source, key, col, detectors)}) s ON s.{key} = k.{key} GROUP BY k.{key}"
    )


def _routes(source: str, key: str, col: str, threshold: int, loose: list[Detector] = LOOSE) -> str:
    return (
        f"SELECT *, CASE WHEN total_segments = 0 THEN 'ignored' WHEN total_segments >= {threshold} "
        f"THEN 'inline' ELSE 'dictionary' END AS route FROM ({_counts(source, key, col, loose)})"
    )


def _hybrid(
    source: str,
    key: str,
    row: str,
    col: str,
    threshold: int,
    before: str = "",
    strict: list[Detector] = STRICT,
    loose: list[Detector] = LOOSE,
) -> str:
    """``row`` identifies a row of the source."""
    steps, last = _scrub_steps(source, f"{key}, {row}", col, strict)
    return (
        f"WITH {before + ', ' if before else ''}routes AS ({_routes(source, key, col, threshold, loose)}), "
        f"dict AS ({_entries(source, key, col, loose)}), {steps} "
        f"SELECT l.{key}, l.{row}, CASE route WHEN 'ignored' THEN l.{col} WHEN 'inline' THEN s.{col} "
        f"ELSE {_fold('l.' + col)} END AS {col} FROM {source} l JOIN routes r ON r.{key} = l.{key} "
        f"JOIN {last} s ON s.{row} = l.{row} AND s.{key} = l.{key} LEFT JOIN dict ON dict.{key} = l.{key}"
    )


def _opted_in(hint: str) -> str:
    """CTEs over log_lines: ``skipped`` files and the lines of the ``kept`` ones."""
    return (
        "skipped AS (SELECT file FROM (SELECT file, arg_min(line, line_no) AS first_line "
        f"FROM log_lines GROUP BY file) WHERE contains(first_line, {_q(OPT_OUT_MARKER)}) "
        f"OR regexp_matches(first_line, {_q(hint)})), "
        "kept AS (SELECT * FROM log_lines WHERE file NOT IN (SELECT file FROM skipped))"
    )


def _size_label(n: str) -> str:
    cases = "".join(
        f" WHEN {n} >= {1024**p} THEN CAST(floor({n} / {1024**p}) AS BIGINT) || ' {unit}'"
        for p, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"))
    )
    return f"CASE{cases} ELSE {n} || ' B' END"


def _profile(key: str) -> str:
    lines = (
        "length(text) - length(replace(text, chr(10), '')) "
        "+ CAST(text <> '' AND NOT ends_with(text, chr(10)) AS INTEGER)"
    )
    return (
        f"SELECT *, {_size_label('n_bytes')} AS size_label FROM (SELECT {key}, count(text) AS n_texts, "
        f"CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(sum({lines}) AS BIGINT) AS n_lines "
        f"FROM documents GROUP BY {key})"
    )


def _split(n: int, min_bytes: int) -> str:
    """Documents as lines with their part number."""
    return (
        "SELECT doc_id, pos, line, CASE WHEN strlen(text) > "
        f"{min_bytes} THEN CAST(floor(pos * {n} / n_lines) AS INTEGER) ELSE 0 END AS part_no FROM ("
        "SELECT doc_id, text, len(lines) AS n_lines, unnest(lines) AS line, unnest(range(len(lines))) AS pos "
        "FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents))"
    )


def _summary(counts: str, before: str, skipped: str = "(SELECT count(*) FROM skipped)", bad: str = "0") -> str:
    """One row from counts per file."""
    sums = ", ".join(
        f"CAST(coalesce(sum({count_column(d.kind)}), 0) AS BIGINT) AS {count_column(d.kind)}" for d in LOOSE
    )
    return (
        f"WITH {before}, counts AS ({counts}) "
        "SELECT *, CASE WHEN files_seen > opted_out + not_text THEN 'SUCCESS' ELSE 'IGNORED' END AS status FROM ("
        "SELECT (SELECT count(DISTINCT file) FROM log_lines) AS files_seen, "
        f"CAST({skipped} AS BIGINT) AS opted_out, CAST(0 AS BIGINT) AS not_text, "
        "count(*) FILTER (WHERE total_segments = 0) AS untouched, "
        "count(*) FILTER (WHERE total_segments > 0) AS rewritten, "
        f"CAST({bad} AS BIGINT) AS quarantined_lines, {sums} FROM counts)"
    )


_IN_LINES = f"WITH {LL} "
_LL_KEYS = "file, line_no"


def _lines(kind: str, profile: list[Detector]) -> str:
    return _IN_LINES + _found("log_lines", _LL_KEYS, "line", pick(profile, kind))


def _docs(detectors: list[Detector]) -> str:
    return _found("documents", "doc_id", "text", detectors)


def _build() -> dict[str, str]:
    scrub_lines = _scrub("log_lines", _LL_KEYS, "line", STRICT, LL)
    nth = "row_number() OVER (PARTITION BY file ORDER BY line_no) AS nth"
    log_segments = _distinct("log_lines", "file", "line", LOOSE)
    clean_log_segments = _cleaned(log_segments, "file")
    log_dictionary = (
        f"SELECT kind, segment, {_token('kind', 'segment')} AS token "
        f"FROM (SELECT DISTINCT kind, segment FROM ({log_segments}))"
    )
    parts = (
        "SELECT doc_id, part_no, string_agg(line, chr(10) ORDER BY pos) AS value "
        f"FROM ({_split(NUM_PARTS, MIN_SPLIT)}) GROUP BY doc_id, part_no"
    )
    # Parts that exist are numbered without gaps.
    parts = (
        "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part_no) - 1 AS INTEGER) "
        f"AS part_no, value FROM ({parts})"
    )
    scrub_docs = _scrub("documents", "doc_id", "text", STRICT)
    log_rewrite = _dictionary_rewrite("log_lines", "file", "line_no", "line", LL)
    opted_in = f"{LL}, {_opted_in(HINT)}"
    columns = ", ".join([*(count_column(d.kind) for d in LOOSE), "total_segments"])
    by_route = (
        f"SELECT file, {columns} FROM ({_routes('kept', 'file', 'line', 200)}) WHERE route <> 'inline' UNION ALL "
        f"SELECT file, {columns} FROM ({_counts('kept', 'file', 'line', STRICT)}) WHERE file IN "
        f"(SELECT file FROM ({_routes('kept', 'file', 'line', 200)}) WHERE route = 'inline')"
    )
    ends = "CASE WHEN line_no % 2 = 0 THEN line || chr(39) || chr(39) ELSE line END AS line"
    readable = "CASE WHEN line_no % 17 <> 0 THEN line END AS line"
    bad_lines = "(SELECT count(*) FROM log_lines WHERE line_no % 17 = 0)"
    coin = "CASE WHEN left(md5('1234' || file), 1) < '8' THEN 'split_merge' ELSE 'split_in_place' END"
    card = [*STRICT, CARD]
    oracles = {
        "a1_scan_text_corpus": f"{_IN_LINES} SELECT file, {nth}, line FROM log_lines",
        "a1_rescan_mirrored": f"{_IN_LINES} SELECT file, {nth}, line FROM log_lines",
        "a2_opt_out": f"WITH {LL}, {_opted_in(HINT)} SELECT * FROM kept",
        "a3_quarantine": (
            f"{_IN_LINES} SELECT file, count(*) FILTER (WHERE line_no % 17 <> 0) AS n_good, "
            "count(*) FILTER (WHERE line_no % 17 = 0) AS n_bad FROM log_lines GROUP BY file"
        ),
        "a3_quarantine_sink": (
            f"{_IN_LINES} SELECT file, count(*) AS n_bad FROM log_lines WHERE line_no % 17 = 0 GROUP BY file"
        ),
        "a4_profile_sources": _profile("source"),
        "a4_profile_documents": _profile("doc_id"),
        "a4_profile_files": (
            f"{_IN_LINES} SELECT file, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, "
            "count(*) AS n_lines FROM log_lines GROUP BY file"
        ),
        "a5_write_mirrored": f"SELECT file, {nth}, line FROM ({scrub_lines})",
        "a5_run_folder": f"SELECT file, {nth}, line FROM ({scrub_lines})",
        "a5_write_parquet": scrub_lines,
        "a6_replace_in_place": f"SELECT file, line FROM ({scrub_lines})",
        "a6_replace_twice": f"SELECT file, {nth}, line FROM ({scrub_lines})",
        "a7_split_parts": parts,
        "a8_merge_parts": "SELECT doc_id, text FROM documents",
        "b1_detect_ipv4": _docs(pick(STRICT, IPV4)),
        "b2_detect_ipv4_loose": _lines(IPV4, LOOSE),
        "b3_detect_ipv6": _lines(IPV6, LOOSE),
        "b4_detect_mac": _lines(MAC_ADDR, LOOSE),
        "b4_detect_mac_strict": _lines(MAC_ADDR, STRICT),
        "b5_detect_paths_log_lines": _lines(FILE_DIR, STRICT),
        "b5_detect_paths_urls": _found("pages", "page_id", "url", pick(STRICT, FILE_DIR)),
        "b5_detect_paths_html": _found("pages", "page_id", "html", pick(STRICT, FILE_DIR)),
        "b6_detect_credentials": _docs(pick(STRICT, CREDENTIALS)),
        "b6_detect_credentials_log_lines": _lines(CREDENTIALS, LOOSE),
        "b7_detect_all_documents": _docs(STRICT),
        "b7_detect_all_log_lines": _IN_LINES + _found("log_lines", _LL_KEYS, "line", LOOSE),
        "b8_sensitive_documents": f"SELECT DISTINCT doc_id FROM ({_docs(STRICT)})",
        "b8_sensitive_turns": "SELECT DISTINCT conv_id, turn FROM ("
        + _found("conversations", "conv_id, turn", "text", STRICT)
        + ")",
        "b8_sensitive_lines": f"{_IN_LINES} SELECT DISTINCT file, line_no FROM ("
        + _found("log_lines", _LL_KEYS, "line", STRICT)
        + ")",
        "c1_distinct_segments": _IN_LINES + log_segments,
        "c1_distinct_segments_documents": _distinct("documents", "source", "text", STRICT),
        "c2_clean_segments": _IN_LINES + clean_log_segments,
        "c2_clean_segments_pages": _cleaned(_distinct("pages", "page_id", "html", LOOSE), "page_id"),
        "c2_clean_segments_quoted": f"WITH {LL}, quoted AS (SELECT file, line_no, {ends} FROM log_lines) "
        + _cleaned(_distinct("quoted", "file", "line", LOOSE), "file"),
        "c3_longest_first": (
            f"{_IN_LINES} SELECT file, kind, segment, row_number() OVER (PARTITION BY file, kind "
            f"ORDER BY length(segment) DESC, segment) AS rank FROM ({clean_log_segments})"
        ),
        "c3_longest_first_documents": (
            "SELECT source, kind, segment, row_number() OVER (PARTITION BY source, kind "
            "ORDER BY length(segment) DESC, segment) AS rank "
            f"FROM ({_cleaned(_distinct('documents', 'source', 'text', LOOSE), 'source')})"
        ),
        "c4_segment_counts": _IN_LINES + _counts("log_lines", "file", "line", LOOSE),
        "c4_segment_counts_documents": _counts("documents", "doc_id", "text", STRICT),
        "c5_precedence": (
            f"{_IN_LINES} SELECT file, kind, segment, row_number() OVER (PARTITION BY file ORDER BY "
            f"{_priority(LOOSE)}, length(segment) DESC, segment) AS rank FROM ({clean_log_segments})"
        ),
        "d1_tokens": f"SELECT *, {_token('kind', 'segment')} AS token FROM ({_docs(STRICT)})",
        "d1_tokens_wide": (
            f"SELECT *, {_mac_token('kind', 'segment', 'pepper', 16)} AS token "
            f"FROM ({_lines(IPV4, STRICT)})"
        ),
        "d2_scrub_documents": scrub_docs,
        "d2_scrub_log_lines": scrub_lines,
        "d2_scrub_addresses_first": _scrub("log_lines", _LL_KEYS, "line", addresses_first(STRICT), LL),
        "d2_scrub_paths_first": _scrub("log_lines", _LL_KEYS, "line", paths_first(STRICT), LL),
        "d2_scrub_pages": _scrub("pages", "page_id, url", "html", STRICT),
        "d3_dictionary_rewrite": log_rewrite,
        "d3_dictionary_rewrite_wide": log_rewrite,
        "d3_dictionary_rewrite_documents": _dictionary_rewrite("documents", "source", "doc_id", "text"),
        "d3_dictionary_rewrite_documents_wide": _dictionary_rewrite("documents", "source", "doc_id", "text"),
        "d4_mask_documents": _mask("documents", "doc_id", "text", LOOSE),
        "d4_mask_log_lines": _IN_LINES + _mask("log_lines", _LL_KEYS, "line", LOOSE),
        "d5_token_dictionary": _IN_LINES + log_dictionary,
        "d5_token_dictionary_documents": (
            f"SELECT kind, segment, {_token('kind', 'segment')} AS token FROM "
            f"(SELECT DISTINCT kind, segment FROM ({_docs(STRICT)}))"
        ),
        "d6_token_collisions": (
            f"{_IN_LINES} SELECT kind, token, count(DISTINCT segment) AS n_segments "
            f"FROM ({log_dictionary}) GROUP BY kind, token HAVING count(DISTINCT segment) > 1"
        ),
        "e1_density_routes": _IN_LINES + _routes("log_lines", "file", "line", 200),
        "e2_coin_routes": (
            f"{_IN_LINES} SELECT DISTINCT file, CASE WHEN left(md5('1234' || file), 1) < '8' "
            "THEN 'split_merge' ELSE 'split_in_place' END AS route FROM log_lines"
        ),
        "e3_size_routes": (
            f"SELECT doc_id, CASE WHEN strlen(text) > {MIN_SPLIT} THEN 'split' ELSE 'whole' END AS route "
            "FROM documents"
        ),
        "s1_in_place": scrub_lines,
        "s2_sam": scrub_lines,
        "s2_sam_documents": scrub_docs,
        "s3_sip": scrub_lines,
        "s3_sip_documents": scrub_docs,
        "s6_hybrid_split_documents": scrub_docs,
        "s6_hybrid_split_sinks": f"SELECT {coin} AS sink, file, line FROM ({scrub_lines})",
        "s4_low_level": log_rewrite,
        "s5_hybrid": _hybrid("log_lines", "file", "line_no", "line", 200, LL),
        "s5_hybrid_documents": _hybrid("documents", "source", "doc_id", "text", 5),
        "s6_hybrid_split": scrub_lines,
        "s7_ripgrep": _IN_LINES + _mask("log_lines", _LL_KEYS, "line", LOOSE),
        "g1_run_summary": _summary(by_route, opted_in),
        "g1_run_summary_in_place": _summary(_counts("kept", "file", "line", STRICT), opted_in),
        "g1_run_summary_low_level": _summary(_counts("kept", "file", "line", LOOSE), opted_in),
        "g1_run_summary_ripgrep": _summary(_counts("kept", "file", "line", LOOSE), opted_in),
        "g1_run_summary_quarantine": _summary(
            _counts("readable", "file", "line", STRICT),
            f"{LL}, readable AS (SELECT file, line_no, {readable} FROM log_lines)",
            "0",
            bad_lines,
        ),
        "g2_run_timing": (
            "SELECT count(*) AS rows_written, count(*) AS rows_observed, "
            f"CAST(sum(strlen(line)) AS BIGINT) AS bytes_observed, TRUE AS took_time FROM ({scrub_lines})"
        ),
        "u1_custom_detector": _scrub("documents", "doc_id", "text", card),
        "u1_custom_detector_matches": _docs(card),
        "u1_custom_digits": _scrub("log_lines", _LL_KEYS, "line", with_detector(STRICT, FIVE), LL),
        "u1_custom_negated": _scrub("log_lines", _LL_KEYS, "line", with_detector(STRICT, SIX), LL),
        "u1_custom_negated_mask": _IN_LINES + _mask("log_lines", _LL_KEYS, "line", with_detector(LOOSE, SIX)),
        "u1_custom_hybrid": _hybrid(
            "log_lines", "file", "line_no", "line", 200, LL, with_detector(STRICT, WORD), with_detector(LOOSE, WORD)
        ),
        "u1_custom_low_level": _dictionary_rewrite(
            "log_lines", "file", "line_no", "line", LL, with_detector(LOOSE, WORD)
        ),
        "u2_sql_functions": (
            f"SELECT file, line_no, line, {_token(_q(IPV4), 'file')} AS file_token FROM ({scrub_lines})"
        ),
    }
    return oracles


ORACLES: dict[str, str] = _build()
