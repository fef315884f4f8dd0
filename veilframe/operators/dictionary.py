"""Per-file dictionaries: building, reporting, and rewriting by them.

The segments of a file are collected from all its lines, then replaced as
plain text wherever they occur in that file, in rewriting order (kind
priority, then longest first).  An entry counts for a line when the line, as
it was before the run, contains it; so tokens are never rewritten themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.detectors import Detector
from veilframe.functions.matching import with_alphabet
from veilframe.functions.tokens import TokenRule, seal, unseal
from veilframe.operators.joins import attach
from veilframe.operators.segments import distinct_segments, priority_of
from veilframe.shared import content_bytes, names, row_bytes, written

_TAIL = 3
# Characters of the runs by which words look up a large dictionary, for words
# that have as many, and of the windows that long lines are cut into.
_GRAM, _LONG_GRAM = 5, 8
_WINDOW = 1 << 16
# A run of other characters than blanks, with the blank before it.
_WORD = r"[ \t\n]?[^ \t\n]+"
# Characters by which words may be told from ordinary ones, those seldom in prose first.
_DIGITS = "0123456789"
_SIGNS = (_DIGITS, *"/\\:=@_|{}[]<>#$%&*+~^`\"()!?;'-,.")
# Words, common to entries without such a character, that a text is searched for at most.
_MAX_LITERALS = 32
# One of so many lines shows whether leaving words without a sign out is worth it.
_SHOWN = 64
# Comparing a line with more entries than this costs more than looking it up.
_FEW_ENTRIES = 64
# At most so many frequent runs, or frequent words without an entry, are sent to all tasks.
_FREQUENT_RUNS = 500_000
_FREQUENT_WORDS = 20_000
# Different runs of one length that are sent to all tasks.
_FEW_GRAMS = 400_000
# Runs of a segment that are compared at most, a power of two.
_MAX_RUNS = 1 << 20
# A dictionary beyond this size never rides next to a line, however few entries it has.
_MAX_INLINE_BYTES = 4 * 1024 * 1024


def token_dictionary(
    df: DataFrame, key: str | Sequence[str], col: str, detectors: list[Detector], tokens: TokenRule
) -> DataFrame:
    """``(kind, segment, token)`` over the whole corpus, each segment once.

    This undoes the masking: keep it where only few can read it.
    """
    segments = distinct_segments(df, key, col, detectors).select("kind", "segment").distinct()
    return segments.withColumn("token", tokens.token_by(F.col("kind"), F.col("segment")))


def token_collisions(dictionary: DataFrame) -> DataFrame:
    """Tokens that stand for more than one segment: ``(kind, token, n_segments)``."""
    return (
        dictionary.groupBy("kind", "token")
        .agg(F.count("segment").alias("n_segments"))
        .where(F.col("n_segments") > 1)
    )


def entries(segments: DataFrame, detectors: list[Detector], tokens: TokenRule) -> DataFrame:
    """Cleaned segments with token and sort fields, ready to be collected."""
    return segments.select(
        *[c for c in segments.columns if c not in ("kind", "segment")],
        priority_of(F.col("kind"), detectors).cast("int").alias("priority"),
        (-F.length("segment")).cast("int").alias("neg_length"),
        "segment",
        tokens.token_by(F.col("kind"), F.col("segment")).alias("token"),
    )


def _entry() -> Column:
    return F.struct("priority", "neg_length", "segment", "token")


def _fold(line: Column, ordered: Column) -> Column:
    """The line with all entries replaced; finished tokens are sealed, so that
    no later entry finds its text inside them."""

    def folded(text: Column, chosen: Column) -> Column:
        replaced = F.aggregate(ordered, text, lambda now, e: F.replace(now, e["segment"], seal(e["token"], chosen)))
        return unseal(replaced, chosen)

    return with_alphabet(line, folded)


def _indexed(dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """``(key…, _by_tail)``: the entries of a key grouped by their last
    characters.  A line needs to be compared only with the entries whose tail
    it contains; heads are often all the same (``/var/log``, ``10.0.``)."""
    tail = F.right("segment", F.lit(_TAIL)).alias("tail")
    by_tail = dictionary.groupBy(*keys, tail).agg(F.collect_list(_entry()).alias("entries"))
    return by_tail.groupBy(*keys).agg(F.collect_list(F.struct("tail", "entries")).alias("_by_tail"))


def _contained(line: Column, by_tail: Column) -> Column:
    """The entries a line contains, in rewriting order."""
    groups = F.filter(by_tail, lambda g: F.contains(line, g["tail"]))
    near = F.flatten(F.transform(groups, lambda g: g["entries"]))
    return F.array_sort(F.filter(near, lambda e: F.contains(line, e["segment"])))


def rewrite_by_entries(
    df: DataFrame,
    key: str | Sequence[str],
    col: str,
    dictionary: DataFrame,
    out: str,
    *,
    max_inline_entries: int,
    broadcast_limit: int,
    carry: DataFrame | None = None,
    when: Column | None = None,
) -> DataFrame:
    """Rewrite ``col`` into ``out`` by the ``entries`` of each row's key.

    ``dictionary`` must be written to shared storage; it is read several times.
    Keys with few entries (``_FEW_ENTRIES``, or ``max_inline_entries`` if fewer)
    carry them as one indexed array next to each line (``_indexed``).  Larger
    ones are never put into one row: the words of their lines look up the
    entries they contain by an equi-join (``_found_by_words``).

    ``carry`` holds further columns, one row per key, that ride on the same
    join; it must be written too.  ``when`` (which may use them) limits the
    rewriting to some rows; the others get null.
    """
    keys = names(key)
    use = F.lit(True) if when is None else when
    sizes = dictionary.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sum(row_bytes(dictionary)).alias("_bytes")
    )
    is_wide = (F.col("_n") > min(max_inline_entries, _FEW_ENTRIES)) | (F.col("_bytes") > _MAX_INLINE_BYTES)
    any_wide, size = sizes.agg(
        F.coalesce(F.max(is_wide), F.lit(False)), F.coalesce(F.sum("_bytes"), F.lit(0))
    ).first()

    narrow, narrow_rows = dictionary, df
    wide = wide_keys = None
    if any_wide:
        wide_keys = written(sizes.where(is_wide).select(*keys), "wide-keys")
        flagged = attach(
            dictionary, wide_keys.withColumn("_wide", F.lit(True)), keys, broadcast_limit=broadcast_limit
        )
        narrow = flagged.where(F.col("_wide").isNull()).drop("_wide")
        wide = written(flagged.where("_wide").drop("_wide"), "wide")
        size = content_bytes(narrow)
        narrow_rows = attach(df, wide_keys, keys, "left_anti", broadcast_limit=broadcast_limit)

    per_key = _indexed(narrow, keys)
    if carry is not None:
        per_key = attach(carry, per_key, keys, broadcast_limit=broadcast_limit, right_bytes=size)
        size += content_bytes(carry)

    lined = attach(narrow_rows, per_key, keys, broadcast_limit=broadcast_limit, right_bytes=size)
    folded = _fold(F.col(col), _contained(F.col(col), F.col("_by_tail")))
    result = lined.withColumn(out, F.when(use, F.coalesce(folded, F.col(col)))).drop("_by_tail")
    if wide is None:
        return result

    rows = attach(df, wide_keys, keys, "left_semi", broadcast_limit=broadcast_limit)
    if carry is not None:
        rows = attach(rows, carry, keys, broadcast_limit=broadcast_limit)
    rows = written(rows.withColumn("_line", F.monotonically_increasing_id()), "rows")
    texts = rows.where(use & F.col(col).isNotNull()).select(*keys, "_line", F.col(col).alias("_text"))
    near = written(_found_by_words(texts, keys, wide, broadcast_limit), "near")
    # Few lines hold an entry, as a rule; the others need not be sorted to learn that.
    if content_bytes(near) <= broadcast_limit:
        found = rows.join(F.broadcast(near), "_line", "left")
    else:
        found = rows.hint("merge").join(near, "_line", "left")
    held = F.array_sort(F.filter("_near", lambda e: F.contains(F.col(col), e["segment"])))
    folded = F.when(F.col("_near").isNotNull(), _fold(F.col(col), held))
    looked_up = found.withColumn(out, F.when(use, F.coalesce(folded, F.col(col)))).drop("_near", "_line")
    return result.unionByName(looked_up)


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters; a zero-width match yields the
    run at every place, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _words(text: Column) -> Column:
    """The distinct words of a text.  Where a trimmed segment occurs, each of
    its words lies within a word of the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))


def _with_sign(text: Column, signs: list[str]) -> Column:
    """Those of the ``_words`` that hold one of ``signs``, in one pass; each word
    is looked at once, from the text's start or the blank before it."""
    of = "".join(sign if sign == _DIGITS else f"\\{sign}" for sign in signs)
    found = F.regexp_extract_all(text, F.lit(rf"(?:^|[ \t\n])[^ \t\n{of}]*+[{of}][^ \t\n]*+"), F.lit(0))
    return F.when(text.rlike(f"[{of}]"), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _words_to_ask(lines: DataFrame, by_gram: DataFrame) -> Callable[[Column], Column] | None:
    """The words of a text that may hold the word by which an entry is filed, or
    None if these are most of them, as shown by some of the ``lines``.

    A filed word with a sign lies in words with that sign.  Entries filed without
    one share few words (the keywords of credentials); only a text that holds one
    of these literals has to ask for all its words.
    """
    filed = by_gram.select(F.explode("entries").alias("e")).select("e.word", F.col("e.entry.segment").alias("segment"))
    word, segment, text = F.col("word"), F.col("segment"), F.col("_text")
    held = [F.when(word.rlike("[0-9]") if sign == _DIGITS else F.contains(word, F.lit(sign)), F.lit(sign)) for sign in _SIGNS]
    signed = filed.withColumn("sign", F.coalesce(*held))
    signs = [r["sign"] for r in signed.where(F.col("sign").isNotNull()).select("sign").distinct().collect()]  # some of _SIGNS
    plain = signed.where(F.col("sign").isNull()).select("segment").distinct()
    counts = plain.select(F.explode(_words(segment)).alias("word")).groupBy("word").count()
    literals = [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(_MAX_LITERALS).collect()]

    def holds(literal_in: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(literal_in, F.lit(w)) for w in literals], F.lit(False))

    if not signs or not plain.where(~holds(segment)).isEmpty():
        return None

    def asked(of: Column) -> Column:
        return F.when(holds(of), _words(of)).otherwise(_with_sign(of, signs)) if literals else _with_sign(of, signs)

    some = lines.where(F.pmod(F.xxhash64("_line"), F.lit(_SHOWN)) == 0)
    n_asked, n_all = some.agg(F.sum(F.size(asked(text))), F.sum(F.size(_words(text)))).first()
    return asked if 2 * (n_asked or 0) < (n_all or 0) else None


def _with_rarest(df: DataFrame, keys: list[str], of: str, runs: Callable[[Column], Column], name: str) -> DataFrame:
    """Adds that of a text's ``runs`` which few rows of its key hold.

    Only frequent runs are counted against each other; fewer than
    ``_FREQUENT_RUNS`` can be, whatever the data.  The others are told apart by
    hash, so that texts that share some do not all take the same.
    """
    df = written(df.withColumn("_row", F.monotonically_increasing_id()), "segments-by-row")
    total = df.agg(F.sum(F.length(of).cast("bigint"))).first()[0] or 0
    some = F.slice(runs(F.col(of)), 1, _MAX_RUNS)
    held = df.select("_row", *keys, F.posexplode(some).alias("_at", "_text")).select("_row", "_at", F.xxhash64(*keys, "_text").alias("_run"))
    counts = held.groupBy("_run").agg(F.count("*").alias("_n"))
    frequent = F.broadcast(counts.where((F.col("_n") > 1) & (F.col("_n") * _FREQUENT_RUNS > total)))
    # Count, hash and place in one number, which is aggregated without sorting.
    n = F.least(F.coalesce("_n", F.lit(1)), F.lit(1 << 30))
    order = (n * F.lit(1 << 12) + F.pmod("_run", F.lit(1 << 12))) * F.lit(_MAX_RUNS) + F.col("_at")
    least = held.join(frequent, "_run", "left").groupBy("_row").agg(F.min(order).alias("_least"))
    at = F.pmod("_least", F.lit(_MAX_RUNS)).cast("int")
    return df.hint("merge").join(least, "_row").withColumn(name, F.get(some, at)).drop("_row", "_least")


def _by_rarest_gram(wide: DataFrame, keys: list[str]) -> DataFrame:
    """``(key…, gram, entries)``: each entry, with the rarest of its words,
    under the rarest gram of that; a shorter word is its own gram."""

    def grams(word: Column) -> Column:
        by_length = F.when(F.length(word) >= _LONG_GRAM, _grams(word, _LONG_GRAM)).when(F.length(word) >= _GRAM, _grams(word, _GRAM))
        return by_length.otherwise(F.array(word))

    filed = _with_rarest(_with_rarest(wide, keys, "segment", _words, "word"), keys, "word", grams, "gram")
    return filed.groupBy(*keys, "gram").agg(F.collect_list(F.struct("word", _entry().alias("entry"))).alias("entries"))


def _asked_grams(vocabulary: DataFrame, by_word: list[str], by_gram: DataFrame) -> DataFrame:
    """``(key…, word, gram)``: the grams of every word, of the sizes in use.
    Of sizes with few different ones, those of no entry are left out at once."""
    grams = by_gram.select("gram").distinct().withColumn("size", F.length("gram"))
    n_grams = {r["size"]: r["count"] for r in grams.groupBy("size").count().collect()}  # at most _GRAM + 1 numbers
    listed = [size for size, n in n_grams.items() if n <= _FEW_GRAMS]

    def asked(sizes: list[int]) -> DataFrame:
        of_sizes = F.flatten(F.array(*[_grams(F.col("word"), n) for n in sizes]))
        return vocabulary.select(*by_word, F.explode(of_sizes).alias("gram"))

    rest = [size for size in n_grams if size not in listed]
    parts = [asked(rest)] if rest else []
    if listed:
        few = F.broadcast(grams.where(F.col("size").isin(listed)).select("gram"))
        parts.append(asked(listed).join(few, "gram", "left_semi").select(*by_word, "gram"))
    return reduce(DataFrame.unionByName, parts)


def _found_by_words(
    texts: DataFrame, keys: list[str], wide: DataFrame, broadcast_limit: int
) -> DataFrame:
    """``(_line, _near)``: the entries of which a line of ``(key…, _line,
    _text)`` holds the rarest word, hence all that it contains.

    Everything is found by equality, so the cost does not grow with lines times
    entries.  The distinct words of a key's lines look up the entries, which are
    filed under their rarest gram, by all of their own grams; lines then look up
    their words.  Words that can hold no entry's word by their characters are left
    out where they are most of a text (``_words_to_ask``).  Long lines are cut into windows that overlap by the longest
    entry, so that each occurrence lies in one, and windows are dealt out.
    """
    by_gram = written(_by_rarest_gram(wide, keys), "by-gram")
    longest = -(wide.agg(F.min("neg_length")).first()[0] or 0)
    text = F.col("_text")
    n_windows = F.greatest(F.ceil(F.length(text) / F.lit(_WINDOW)), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0).cast("bigint"), n_windows - 1), lambda n: F.substr(text, n * _WINDOW + 1, F.lit(_WINDOW + longest)))
    windows = texts
    if (texts.agg(F.max(F.length(text))).first()[0] or 0) > _WINDOW:
        cut_up = texts.where(n_windows > 1).select(*keys, "_line", F.posexplode(cut).alias("_window", "_text"))
        dealt = written(cut_up.repartition("_line", "_window"), "windows")
        windows = texts.where(n_windows == 1).unionByName(dealt.drop("_window"))
    by_word = [*keys, "word"]
    few = _words_to_ask(windows, by_gram)
    asked = windows.select(*keys, "_line", F.explode((few or _words)(text)).alias("word"))
    if few:
        asked = written(asked, "asked")
    vocabulary = written(asked.groupBy(*by_word).agg(F.count("*").alias("n")), "words")

    word = F.col("word")
    hits = attach(_asked_grams(vocabulary, by_word, by_gram), by_gram, [*keys, "gram"], "inner", broadcast_limit=broadcast_limit)
    held = F.transform(F.filter("entries", lambda e: F.contains(word, e["word"])), lambda e: e["entry"])
    hits = hits.select(*by_word, held.alias("held")).where(F.size("held") > 0)
    hits = written(hits.groupBy(*by_word).agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("near")), "hits")

    # Most of a text are words that hold nothing; the most frequent need not travel.
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    frequent = vocabulary.where((F.col("n") * _FREQUENT_WORDS > total) & (F.length(word) <= _GRAM * 20))
    idle = written(attach(frequent, hits, by_word, "left_anti", broadcast_limit=broadcast_limit), "idle")
    left = attach(asked, idle.select(*by_word), by_word, "left_anti", broadcast_limit=1 << 25)
    counted = attach(vocabulary, idle.select(*by_word), by_word, "left_anti", broadcast_limit=1 << 25)
    met = attach(left, hits, by_word, "inner", broadcast_limit=broadcast_limit, counted=counted)
    return met.groupBy("_line").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("_near"))


def rewrite_with_dictionary(
    df: DataFrame,
    key: str | Sequence[str],
    col: str,
    detectors: list[Detector],
    tokens: TokenRule,
    out: str | None = None,
    *,
    max_inline_entries: int = 5_000,
    broadcast_limit: int = 32 * 1024 * 1024,
) -> DataFrame:
    """Collect the segments of every key, then replace them in its lines."""
    segments = distinct_segments(df, key, col, detectors, clean=True)
    target = out or col
    result = rewrite_by_entries(
        df,
        key,
        col,
        written(entries(segments, detectors, tokens), "entries"),
        "_dictionary_out",
        max_inline_entries=max_inline_entries,
        broadcast_limit=broadcast_limit,
    )
    return result.withColumn(target, F.col("_dictionary_out")).drop("_dictionary_out")
