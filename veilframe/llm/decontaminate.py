"""Benchmark decontamination by templates, with DataFrame functions only.

Numbers, names and units become typed placeholders, so a question keeps its
template when it is asked again with other values.  Windows of template words
are hashed and joined, and so are windows of the plain words in lower case, for
copies whose capitals, and with them their names, are lost.  In an alignment of
a document with an item, a value of the item has one image: the document's value
in over half of its slots.  A window counts if its plain words agree or all its
slots hold images.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.shared import content_bytes, written

NUMBER, NAME, UNIT = "⟨num⟩", "⟨name⟩", "⟨unit⟩"
# Units that may follow a number.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hours minutes seconds days weeks months years "
    "km/h mph kb mb gb tb hz khz mhz ghz w kw v a j kj cal kcal usd eur gbp dollars euros pounds cents percent "
    "degrees miles meters metres kilometers kilometres grams kilograms liters litres"
).split()
_BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    """Windows of ``width`` words; a document holds an item if windows that
    agree word for word cover a ``share`` of the item's words, so that few edits
    hide no short item, or if that share of its windows is found at all.  A
    template says something if at least ``plain`` of a window's words are no
    placeholders; rows of numbers are compared as they are."""

    width: int = 6
    share: float = 0.5
    plain: int = 2
    broadcast_limit: int = 8 << 20


def _stripped(text: Column) -> Column:
    """Lower case, without signs; a word of signs only vanishes."""
    return F.lower(F.regexp_replace(text, "[^\\p{L}\\p{N}\\s⟨⟩]+", ""))


def template(text: Column) -> Column:
    """The text with typed placeholders, word for word."""
    # A capital after a small letter or comma and a blank: not a sentence's start.
    named = F.regexp_replace(text, r"(?<=[\p{Ll},;]\x20)\p{Lu}\p{Ll}+", NAME)
    numbered = F.when(F.col("_digits"), F.regexp_replace(named, r"[0-9]+(?:[.,:/\-][0-9]+)*", NUMBER)).otherwise(named)
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    measured = F.regexp_replace(numbered, rf"(?i)(?<={NUMBER}\x20?)(?:{units})(?![\p{{L}}/])", UNIT)
    return _stripped(F.when(F.col("_digits"), measured).otherwise(numbered))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANKS), lambda w: w != "")


def _placed(df: DataFrame, text: Column, keep: list[Column], lengths: list[int], plain: int) -> DataFrame:
    """``keep``, and for every window of one of the ``lengths``: ``at`` (its
    place), ``length``, ``n`` (words of the text) and the ``hash`` of its
    ``verbatim`` words; and once more, if placeholders hide some of them, the
    hash of its template, with the values in its ``slots``."""
    texts = df.select(*keep, F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, " ").alias("_text"))
    texts = texts.withColumn("_digits", F.col("_text").rlike("[0-9]"))
    names = [c for c in texts.columns if c[0] != "_"]
    cut = texts.select(*names, _words(template(F.col("_text"))).alias("_t"), _words(_stripped(F.col("_text"))).alias("_w"))
    hides = F.array_join("_t", " ").contains("⟨")
    hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    cut = cut.withColumn("_g", hashes("_w")).withColumn("_h", F.when(hides, hashes("_t")))
    values = F.zip_with("_t", "_w", lambda t, w: F.when(t.contains("⟨"), w).otherwise(""))
    cut = cut.withColumn("_values", F.when(hides, values))

    def window(i: Column, length: int, hashed: str, slots: Column) -> Column:
        whole = F.xxhash64(F.lit(length), F.slice(hashed, i, length))
        return F.struct((i - 1).alias("at"), F.lit(length).alias("length"), whole.alias("hash"), slots.isNull().alias("verbatim"), slots.alias("slots"))

    def templates(i: Column, length: int) -> Column:
        inside = F.slice("_values", i, length)
        hidden = F.size(F.filter(inside, lambda v: v != ""))
        return F.when(hidden.between(1, length - plain), window(i, length, "_h", inside))

    def windows(length: int) -> Column:
        last = F.size("_g") - length + 1
        places = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        words = F.transform(places, lambda i: window(i, length, "_g", F.lit(None).cast("array<string>")))
        others = F.array_compact(F.transform(places, lambda i: templates(i, length)))
        return F.when(hides, F.concat(words, others)).otherwise(words)

    whole = F.flatten(F.array(*[windows(x) for x in lengths]))
    return cut.select(*names, F.size("_g").alias("n"), F.explode(whole).alias("_w")).select(*names, "n", "_w.*")


def _held(docs: DataFrame, benchmark: DataFrame, id_col: str, item_col: str, text_col: str, s: Settings) -> DataFrame:
    """``(doc, copy, item, share, differs)`` of the documents that hold an item;
    ``copy`` is a hash of the text, so rows that share an id are told apart."""
    size = F.size(_words(_stripped(F.coalesce(F.col(text_col), F.lit("")))))
    shorter = benchmark.select(size.alias("n")).where((F.col("n") > 0) & (F.col("n") < s.width)).distinct()
    # At most width - 1 numbers.
    lengths = [s.width, *sorted(r["n"] for r in shorter.collect())]
    items = _placed(benchmark, F.col(text_col), [F.col(item_col).alias("item")], lengths, s.plain)
    items = items.where(F.col("length") == F.least("n", F.lit(s.width)))
    items = written(items.withColumnsRenamed({"at": "q", "slots": "item_slots"}), "template-windows")
    found = _placed(docs, F.col(text_col), [F.col(id_col).alias("doc"), _copy(text_col).alias("copy")], lengths, s.plain)
    found = found.withColumnsRenamed({"hash": "doc_hash"}).drop("n", "length", "verbatim")
    small = content_bytes(items) <= s.broadcast_limit
    met = found.join(F.broadcast(items) if small else items, F.col("doc_hash") == F.col("hash"))
    slot = lambda x, i: F.struct((F.col("q") + i).alias("p"), x["a"].alias("a"), x["b"].alias("b"))
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.when(~F.col("verbatim"), F.filter(F.transform(pairs, slot), lambda x: x["a"] != ""))
    pairs = F.coalesce(pairs, F.array().cast("array<struct<p:int,a:string,b:string>>"))
    # An alignment holds at most two rows per window of the item, so what is
    # collected is bounded by the item, not by the documents.
    aligned = met.groupBy("doc", "copy", "item", (F.col("at") - F.col("q")).alias("shift"), "n", "length").agg(
        F.collect_set(F.struct("q", pairs.alias("pairs"))).alias("met")
    )
    aligned = aligned.withColumn("slots", F.array_distinct(F.flatten(F.transform("met", lambda w: w["pairs"]))))
    # What most slots of an item's value have is the value's image.
    image = F.filter(
        "slots",
        lambda x: 2 * F.size(F.filter("slots", lambda y: (y["a"] == x["a"]) & (y["b"] == x["b"])))
        > F.size(F.filter("slots", lambda y: y["a"] == x["a"])),
    )
    aligned = aligned.withColumn("image", image)
    same = lambda w: F.forall(w["pairs"], lambda x: x["a"] == x["b"])
    held = F.filter("met", lambda w: same(w) | (F.size(F.array_except(w["pairs"], F.col("image"))) == 0))
    each = aligned.select("doc", "copy", "item", "n", "length", F.explode(held).alias("w"))
    seen = each.select("doc", "copy", "item", "n", "length", (~same(F.col("w"))).alias("differs"), F.col("w.q").alias("q"))
    seen = seen.groupBy("doc", "copy", "item", "n", "length", "q").agg(F.min("differs").alias("differs"))
    held = seen.groupBy("doc", "copy", "item", "n", "length").agg(
        F.sort_array(F.collect_list(F.when(~F.col("differs"), F.col("q")))).alias("places"),
        F.count("*").alias("windows"),
        F.max("differs").alias("differs"),
    )
    # Words covered: each window adds those behind the one before it.
    onward = lambda done, q: F.struct((q + F.col("length")).alias("end"), (done["words"] + q + F.col("length") - F.greatest(done["end"], q)).alias("words"))
    covered = F.aggregate("places", F.struct(F.lit(0).alias("end"), F.lit(0).alias("words")), onward)["words"]
    share = F.greatest(covered / F.col("n"), F.col("windows") / (F.col("n") - F.col("length") + 1))
    return held.withColumn("share", share).where(F.col("share") >= s.share).select("doc", "copy", "item", "share", "differs")


def _copy(text_col: str) -> Column:
    return F.xxhash64(text_col)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    settings: Settings | None = None,
) -> DataFrame:
    """``(doc_id, item_id, share, reparameterised)``: the documents that hold
    an item, with the share of it that is found and whether a value differs.

    Items of fewer words than a window are sought as a whole; items without
    words and null or empty texts match nothing.  Rows with equal ids and texts count
    as one document, and rows with equal ids are reported under that id
    together; a null id is reported as null.  An empty table gives none.
    """
    held = _held(docs, benchmark, id_col, item_col, text_col, settings or Settings())
    return held.groupBy(F.col("doc").alias(id_col), F.col("item").alias(item_col)).agg(
        F.max("share").alias("share"), F.max("differs").alias("reparameterised")
    )


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None
) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark; a row goes for
    its own text only, also if its id is null or not its own."""
    s = settings or Settings()
    bad = _held(docs, benchmark, id_col, "item_id", text_col, s).select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy")).distinct()
    bad = written(bad, "contaminated")
    small = content_bytes(bad) <= s.broadcast_limit
    same = docs[id_col].eqNullSafe(bad["_doc"]) & (F.xxhash64(docs[text_col]) == bad["_copy"])
    return docs.join(F.broadcast(bad) if small else bad, same, "left_anti")
