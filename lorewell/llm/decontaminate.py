"""Benchmark decontamination by template windows, with DataFrame functions only.

A text is cut into words once (``1,500`` and ``2.5`` are one number each) and read in two
views: literal (lower-cased), and template, in which capitalised words, numbers and units
after numbers are typed placeholders.  The hashed windows of both views are made by the
generated code of one scan, joined with those of the benchmark items, and only hits leave
it.  Where template windows of a document fit an item, the values in their slots are
compared copy by copy: in a re-parameterised question, each value of the item stands for
one value of the document and the other way round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.graph import fresh, hinted, saved

#: Words of a window.
WINDOW = 8
#: A document has an item if so many windows, or so large a share of the item's windows, fit.
MIN_WINDOWS, MIN_SHARE = 6, 0.5
#: Words besides placeholders that a template window of under WINDOW words needs, and one of WINDOW words: pages of figures or names are no copies of each other.
MIN_FIXED, FULL_FIXED = 4, 2
#: Bytes of benchmark text up to which its windows are broadcast (two a word at most, under 40 bytes each); beyond, both sides are shuffled.
BROADCAST_BYTES = 1_000_000
#: Units that become a placeholder after a number.
UNITS = "mm cm m km in ft yd mi miles mile meters metres meter metre kilometers kilometres g mg kg lb lbs oz grams kilograms pounds ounces l ml liters litres gallons s sec seconds second min minutes minute h hr hours hour days day weeks week months month years year c f k degrees percent dollars dollar cents euros euro eur usd gbp mph kmh kph hz khz mhz ghz w kw v a j kj cal kcal".split()

#: The point inside a number, and the placeholders of names, numbers and units; texts have blanks for these characters.
_POINT, _NAME, _NUM, _UNIT = _MARKS = "\u0001\u0002\u0003\u0004"
_LETTER = r"[\p{L}\p{N}\x01]"
_KEY = ("id", "text_hash")


def _words(texts: DataFrame) -> DataFrame:
    """Columns literal and template (arrays of words, place by place) instead of ``text``, and low and high: words are at low <= pos < high.

    Columns that are used twice are projected before they are, so that they are not made anew for each use.
    """
    rest = [c for c in texts.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    marked = reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in _MARKS])
    clean = texts.select(*rest, F.when(marked, F.regexp_replace(text, r"[\x01-\x04]", " ")).otherwise(text).alias("clean"))
    joined = F.regexp_replace(F.regexp_replace(F.col("clean"), r"[.](?=[0-9])(?<=[0-9][.])", _POINT), r",(?=[0-9])(?<=[0-9],)", "")
    plain = clean.select(*rest, F.when(F.col("clean").rlike("[0-9][.,][0-9]"), joined).otherwise(F.col("clean")).alias("plain"))
    names = F.regexp_replace("plain", rf"\p{{Lu}}(?<!{_LETTER}\p{{Lu}})\p{{Ll}}{_LETTER}*", _NAME)
    numbers = F.regexp_replace(names, rf"[0-9](?<!{_LETTER}[0-9]){_LETTER}*", _NUM)
    units = F.regexp_replace(numbers, rf"(?iu)\x03[^\p{{L}}\p{{N}}\x01-\x04]+(?:{'|'.join(UNITS)})(?!{_LETTER})", f"{_NUM} {_UNIT}")
    # Each word is one token of its view, so that the two split alike; a split at either end leaves an empty word there.
    out = plain.select(*rest, F.split(F.lower("plain"), r"[^\p{L}\p{N}\x01]+").alias("literal"), F.split(F.lower(units), r"[^\p{L}\p{N}\x01-\x04]+").alias("template"))
    edge = lambda i: (F.element_at("literal", i) == "").cast("int")
    return out.select(*rest, "literal", "template", edge(1).alias("low"), (F.size("literal") - edge(-1)).alias("high"))


def _hash(view: str, n: int, pos: Column) -> Column:
    """The hash of the window of ``n`` words at ``pos`` of a view; it tells size and view."""
    return F.xxhash64(F.lit(f"{view}{n}"), *[F.get(view, pos + k) for k in range(n)])


def _windows(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(the other columns, pos, h): every window of these sizes in both views.

    The arrays are exploded by position and windows are read from them in the same generated
    code; the generators are outer ones, as to others the optimizer adds a filter that it pushes
    below the arrays, which would then be made twice.
    """
    rest = [c for c in texts.columns if c != "text"]
    at = _words(texts).select(*rest, "literal", "template", "low", "high", F.posexplode_outer("literal").alias("pos", "word"))
    pos = F.col("pos")
    inside = lambda n: (pos >= F.col("low")) & (pos + n <= F.col("high"))
    hashes = F.array(*[F.when(inside(n), _hash(view, n, pos)) for n in sizes for view in ("literal", "template")])
    return at.select(*rest, "pos", F.explode_outer(hashes).alias("h")).where("h is not null")


def _item_windows(items: DataFrame, short_items: bool) -> tuple[DataFrame, list[int]]:
    """(item, literal, place, size, n_places, h) of the items' windows, saved, and their sizes."""
    size = F.col("high") - F.col("low")
    words = saved(_words(items).withColumn("size", F.least(size, F.lit(WINDOW))).where((F.col("size") == WINDOW) | (F.lit(short_items) & (F.col("size") > 0))))
    sizes = sorted(r["size"] for r in words.select("size").distinct().collect())

    def part(view: str, n: int) -> DataFrame:
        ends = F.sequence(F.col("low"), F.col("high") - n)
        at = words.where(F.col("size") == n).select("item", view, (size - n + 1).alias("n_places"), F.explode(ends).alias("place"))
        fixed = F.size(F.filter(F.slice(view, F.col("place") + 1, n), lambda w: ~w.isin(_NAME, _NUM, _UNIT)))
        told = F.lit(view == "literal") | (fixed >= (FULL_FIXED if n == WINDOW else MIN_FIXED))
        return at.where(told).select("item", F.lit(view == "literal").alias("literal"), "place", F.lit(n).alias("size"), "n_places", _hash(view, n, F.col("place")).alias("h"))

    parts = [part(view, n) for n in sizes or [WINDOW] for view in ("literal", "template")]
    return saved(reduce(DataFrame.unionByName, parts)), sizes


def _slots(texts: DataFrame, key: str) -> DataFrame:
    """(key, pos, word, kind): the words of a few texts, with the placeholder of each or itself."""
    out = _words(texts).select(key, F.posexplode_outer(F.arrays_zip("literal", "template")).alias("pos", "w"))
    return out.select(key, "pos", F.col("w.literal").alias("word"), F.col("w.template").alias("kind"))


def _copies(templates: DataFrame) -> DataFrame:
    """(doc, item, copy, place, pos, size): the template windows by the copies of the item that they may be of.

    Windows are of one copy if they have one alignment (pos - place), if they follow each other
    in the document with gaps of under two windows (a copy with words put in or left out), or
    if each is the first of its place (a copy in parts).  A window is in one copy of each kind.
    """
    near = Window.partitionBy("doc", "item").orderBy("pos")
    start = F.col("pos") - F.coalesce(F.lag("pos").over(near), F.col("pos")) >= 2 * WINDOW
    runs = templates.withColumn("start", start.cast("int")).withColumn("run", F.sum("start").over(near))
    firsts = templates.groupBy("doc", "item", "place", "size").agg(F.min("pos").alias("pos"))
    copy = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n")).alias("copy")
    aligned = templates.select("doc", "item", copy("a", F.col("pos") - F.col("place")), "place", "pos", "size")
    return aligned.unionByName(runs.select("doc", "item", copy("r", F.col("run")), "place", "pos", "size")).unionByName(firsts.select("doc", "item", copy("f", F.lit(0)), "place", "pos", "size"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", short_items: bool = False) -> DataFrame:
    """(``id_col``, text_hash, items), saved: the documents that hold benchmark items, and which.

    An item is in a document if windows at MIN_WINDOWS places of the item, or at a share
    MIN_SHARE of its places, fit: by their words anywhere, or by template in one copy of the
    item whose slots stand for each other one to one.  With ``short_items``, an item of under
    WINDOW words is one window of its own length, else it is in no document.  A window is found by
    template if FULL_FIXED of its words (MIN_FIXED, if it is such a short item) are no placeholders.  Cases: a null or empty text holds nothing; a very
    long text costs its words, one row at a time; repeated rows (equal id and text) are one
    document; a null id is a document of its own text; several texts of one item id are each
    looked for, and null ones are left out; there are no ties, as every item held is listed;
    empty tables give no row; further columns are ignored, whatever their names.
    """
    item = F.struct(F.col(item_col).alias("id"), F.xxhash64(F.col(item_text_col)).alias("text_hash")).alias("item")
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(item, F.col(item_text_col).alias("text")).dropDuplicates(["item"])
    places, sizes = _item_windows(items, short_items)
    bounded = (items.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0) <= BROADCAST_BYTES
    hint = F.broadcast if bounded else (lambda x: x)
    # A document is its id and text; the key stands for both.
    texts = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")).alias("doc"), F.col(text_col).alias("text"))
    fits = _windows(texts, sizes or [WINDOW]).join(hint(places), "h")
    # Where a literal window is in the document does not matter.
    hits = saved(fits.select("doc", "item", "n_places", "literal", "place", "size", F.when(~F.col("literal"), F.col("pos")).alias("pos")).distinct())
    enough = lambda n: (n >= MIN_WINDOWS) | (n >= MIN_SHARE * F.col("n_places"))
    by_place = hits.groupBy("doc", "item", "n_places", "place").agg(F.max(F.col("literal").cast("int")).alias("literal"))
    n_fit = saved(by_place.groupBy("doc", "item", "n_places").agg(F.count("*").alias("n_all"), F.sum("literal").alias("n_literal")).where(enough(F.col("n_all"))))
    # Words alone decide these; of the others, slots are looked at.
    sure = n_fit.where(enough(F.col("n_literal"))).select("doc", "item")
    unsure = n_fit.where(~enough(F.col("n_literal"))).select("doc", "item", "n_literal", "n_places")
    # Template windows count if the slots of one copy and the item agree one to one.
    templates = saved(_copies(hits.where("not literal").join(unsure, ["doc", "item"], "left_semi")))
    span = F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("k")
    pairs = templates.select("doc", "item", "copy", "place", "pos", span).select("doc", "item", "copy", (F.col("place") + F.col("k")).alias("item_pos"), (F.col("pos") + F.col("k")).alias("pos")).distinct()
    wanted = hinted(saved(unsure.select("doc").distinct()))
    doc_words = _slots(texts.join(wanted, "doc", "left_semi"), "doc").where(F.col("kind").isin(_NAME, _NUM, _UNIT)).select("doc", "pos", F.col("word").alias("doc_word"), "kind")
    item_words = _slots(items, "item").select("item", F.col("pos").alias("item_pos"), F.col("word").alias("item_word"))
    values = saved(pairs.join(hint(item_words), ["item", "item_pos"]).join(doc_words, ["doc", "pos"]).select("doc", "item", "copy", "item_word", "doc_word", "kind").distinct())
    odd = values.groupBy("doc", "item", "copy", "item_word", "kind").agg(F.count("*").alias("c")).where("c > 1").select("doc", "item", "copy")
    odd = odd.union(values.groupBy("doc", "item", "copy", "doc_word", "kind").agg(F.count("*").alias("c")).where("c > 1").select("doc", "item", "copy")).distinct()
    literal = hits.where("literal").select("doc", "item", "place")
    more = templates.join(odd, ["doc", "item", "copy"], "left_anti").join(literal, ["doc", "item", "place"], "left_anti")
    found = more.groupBy("doc", "item", "copy").agg(F.countDistinct("place").alias("n")).join(unsure, ["doc", "item"])
    held = sure.unionByName(found.where(enough(F.col("n") + F.col("n_literal"))).select("doc", "item"))
    out = held.groupBy("doc").agg(F.sort_array(F.collect_set("item.id")).alias("items"))
    return saved(out.select(F.col("doc.id").alias(id_col), F.col("doc.text_hash").alias("text_hash"), "items"))


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """Per row of ``docs``: (``id_col``, contaminated, n_items, items); cases as in :func:`contaminated`."""
    found = contaminated(docs, benchmark, id_col, text_col, **names).select(F.col(id_col).alias("found_id"), F.col("text_hash").alias("found_hash"), "items")
    own = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_hash"))
    both = own.join(hinted(found, F.size("items") * 16 + F.length(F.col("items").cast("string"))), F.col("own_id").eqNullSafe(F.col("found_id")) & (F.col("own_hash") == F.col("found_hash")), "left")
    items = F.coalesce("items", F.array().cast(found.schema["items"].dataType))
    return both.select(F.col("own_id").alias(id_col), F.col("items").isNotNull().alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; cases as in :func:`contaminated`."""
    found_id, found_hash = fresh(docs.columns, "found_id", "found_hash")
    found = contaminated(docs, benchmark, id_col, text_col, **names).select(F.col(id_col).alias(found_id), F.col("text_hash").alias(found_hash))
    same = F.col(id_col).eqNullSafe(F.col(found_id)) & (F.xxhash64(F.col(text_col)) == F.col(found_hash))
    return docs.join(hinted(found), same, "left_anti")
