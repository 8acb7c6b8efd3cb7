"""Find benchmark items in documents although their numbers, names or units were changed; DataFrame functions only.

A text becomes a list of tokens (letters and digits; punctuation separates). Its template has the same length: numbers are
``<num>``, units next to a number ``<unit>``, capitalised words ``<name>``, all else is lower-cased. Windows of ``WINDOW``
template tokens are joined by hash, so a re-parameterised question still meets its item. A meeting lies on a diagonal
(position in the document minus position in the item). On each diagonal the slots are checked: an item value must stand for
one document value, apart from ``1 - AGREE`` of the slots (edited copies). A document leaks an item if its consistent diagonals cover at least ``SHARE`` of the
item's windows.

Three forms of a text are compared, each for itself: the tokens as they are, the tokens with a run of capitalised words folded
into one ``<name>`` (so a two-word name may stand for a one-word one; its value is the run without the words that begin both), and all in lower case without
names (so a copy in another case is found). The first form that meets the rule gives the figures of a result. An item
shorter than a window is one window of its own length. Windows need ``LITERALS`` tokens that are no slots; a window that an item repeats counts once, at its first place. An item that has no such
window as it is (a sum, a series of numbers, a list of names) is compared by its own lower-case tokens instead, so only such an item of fewer than
``LITERALS`` tokens is never found. A copy of a part counts if it has ``SHARE`` of the item's windows, or ``LONG`` windows on one diagonal.

Documents are sifted first: a document is compared only if it shares a window with an item in the folded form, where the item's windows count
as they are and in lower case, so all documents are read in one form and few are rewritten in the others.

Null and empty texts and items hold nothing. Rows without ``doc_id`` or ``item_id`` are left out, repeated rows give one result,
other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from enrichflow.functions.strings import once
from enrichflow.sources.scratch import written

WINDOW, LITERALS, SHARE, AGREE, LONG = 8, 3, 0.5, 0.8, 40
UNITS = ("%", "km", "m", "cm", "mm", "kg", "g", "mg", "lb", "l", "ml", "s", "ms", "min", "h", "hours", "hour", "minutes", "minute",
         "seconds", "days", "day", "weeks", "years", "year", "dollars", "euros", "cents", "meters", "metres", "miles", "feet",
         "inches", "liters", "litres", "grams", "pounds", "percent", "degrees", "mph", "kmh", "kb", "mb", "gb")
_SLOTS = ("<num>", "<unit>", "<name>")
_NAME, _JOINED = r"\p{Lu}\p{Ll}+", "\u0001"
AS_IS, FOLDED, LOWER, OWN = 0, 1, 2, 3


def plain(text: str = "text") -> Column:
    """Tokens separated by one space: letters, digits with inner points and commas, and money and percent signs."""
    out = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(\d)[.,](?=\d)", "$1\u0001")
    out = F.regexp_replace(out, r"(\p{N})(?=\p{L})", "$1 ")
    out = F.regexp_replace(out, r"[$€£%]", " $0 ")
    out = F.regexp_replace(out, "[^\\p{L}\\p{M}\\p{N}%$€£\u0001]+", " ")
    return F.trim(F.translate(out, "\u0001", "."))


def template(text: Column) -> Column:
    """The template of a plain text, token by token."""
    out = F.regexp_replace(text, rf"(?<![^ ]){_NAME}(?:{_JOINED}{_NAME})*+(?![^ ])", "<name>")
    out = F.regexp_replace(out, r"(?<![^ ])\p{N}[\p{N}.]*(?![^ ])", "<num>")
    out = F.regexp_replace(out, r"(?<![^ ])[$€£] <num>", "<unit> <num>")
    out = F.regexp_replace(out, r"(?i)<num> (?:" + "|".join(UNITS) + ")(?![^ ])", "<num> <unit>")
    return F.lower(out)


def _tokens(text: Column) -> Column:
    return F.split(text, " ", -1)


def _folded(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<![^ ])({_NAME}) (?={_NAME}(?![^ ]))", f"$1{_JOINED}")


def _forms(rows: DataFrame, key: str) -> DataFrame:
    """(key, form, plain): the plain text in each form."""
    text = F.col("plain")
    forms = F.array(*(F.struct(F.lit(form).alias("form"), x.alias("plain"))
                      for form, x in ((AS_IS, text), (FOLDED, _folded(text)), (LOWER, F.lower(text)), (OWN, F.lower(text)))))
    return rows.select(key, once(plain()).alias("plain")).select(key, F.explode(once(forms)).alias("f")).select(key, "f.form", "f.plain")


def _hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _codes(rows: DataFrame, key: str) -> DataFrame:
    """(key, form, codes): a hash of each template token, or of each token in the form ``OWN``."""
    read = F.when(F.col("form") == OWN, F.col("plain")).otherwise(template(F.col("plain")))
    return _forms(rows, key).select(key, "form", once(_hashed(once(_tokens(read)))).alias("codes"))


def _windows(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """A row for each run of ``size`` codes: the ``keep`` columns, ``size``, ``at`` and ``hash``."""
    starts = F.sequence(F.lit(0), F.size("codes") - size)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("codes", i + 1, size)))
    return rows.filter(F.size("codes") >= size).select(*keep, F.lit(size).alias("size"), F.posexplode(hashes).alias("at", "hash"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def item_windows(items: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(item_id, form, size, at, hash, total): windows of the items with enough literal tokens, and how many an item has."""
    rows = _codes(items.filter("item_id IS NOT NULL"), "item_id")
    slots = F.array(*(F.xxhash64(F.lit(s)) for s in _SLOTS))
    literal = F.transform("codes", lambda c: ((F.col("form") == OWN) | ~F.array_contains(slots, c)).cast("int"))
    rows = rows.withColumn("literal", literal)
    own = [rows if size == window else rows.filter(F.size("codes") == size) for size in range(1, window + 1)]
    all_ = _union([_windows(part, size, "item_id", "form", "literal") for size, part in enumerate(own, 1)])
    solid = F.aggregate(F.slice("literal", F.col("at") + 1, F.col("size")), F.lit(0), lambda n, x: n + x)
    all_ = written(all_.filter(solid >= literals).groupBy("item_id", "form", "size", "hash").agg(F.min("at").alias("at")))
    counted = all_.groupBy("item_id", "form").agg(F.count_distinct("at").alias("total"))
    plain_items = counted.filter(F.col("form") == AS_IS).select("item_id")
    counted = counted.filter(F.col("form") != OWN).unionByName(counted.filter(F.col("form") == OWN).join(plain_items, "item_id", "left_anti"))
    return all_.join(counted, ["item_id", "form"])


def _sizes(windows: DataFrame) -> list[int]:
    return sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most the window length


def sifted(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id) of documents that share a window with an item in the folded form or, for items compared so, by their own tokens.

    ``windows`` should be stored, so that Spark knows its size and broadcasts it only if small.
    """
    found = []
    for own in (False, True):
        sought = windows.filter(F.col("form") == OWN if own else F.col("form").isin(FOLDED, LOWER))
        sizes = _sizes(sought)
        if not sizes:
            continue
        text = F.lower(F.col("plain")) if own else template(_folded(F.col("plain")))
        rows = docs.filter("doc_id IS NOT NULL").select("doc_id", once(plain()).alias("plain"))
        rows = rows.select("doc_id", once(_hashed(once(_tokens(text)))).alias("codes"))
        met = _union([_windows(rows, size, "doc_id").select("doc_id", "size", "hash") for size in sizes])
        found.append(met.join(sought.select("size", "hash").distinct(), ["size", "hash"], "left_semi").select("doc_id").distinct())
    return _union(found).distinct() if found else docs.select("doc_id").limit(0)


def meetings(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, item_id, form, total, size, at, place): windows of documents that have the hash of an item's window."""
    sizes = _sizes(windows)
    rows = _codes(docs, "doc_id")
    found = _union([_windows(rows, size, "doc_id", "form").withColumnRenamed("at", "place") for size in sizes or [WINDOW]])
    return found.join(windows, ["hash", "size", "form"]).select("doc_id", "item_id", "form", "total", "size", "at", "place").distinct()


def _different(value: Column, stands: Column) -> Column:
    """Both runs of names without the words that begin both ("If" in "If Anna" and "If Mary Ann"); each keeps one word at least."""
    one, two = F.split(value, _JOINED, -1), F.split(stands, _JOINED, -1)
    most = F.least(F.size(one), F.size(two)) - 1
    unequal = F.array_position(F.zip_with(F.slice(one, 1, most), F.slice(two, 1, most), lambda a, b: a == b), False)
    same = F.when(unequal > 0, unequal - 1).otherwise(most).cast("int")

    def rest(words: Column) -> Column:
        return F.array_join(F.slice(words, same + 1, F.size(words)), _JOINED)

    several = F.contains(value, F.lit(_JOINED)) & F.contains(stands, F.lit(_JOINED))
    return F.when(several, F.struct(rest(one).alias("value"), rest(two).alias("stands"))).otherwise(
        F.struct(value.alias("value"), stands.alias("stands")))


def _agreement(near: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, form, diagonal, slots, agreeing): slots on each diagonal, and those with the usual value of their item value."""
    def tokens(frame: DataFrame, key: str, name: str) -> DataFrame:
        return _forms(frame, key).filter("plain <> ''").select(
            key, "form", _tokens(F.col("plain")).alias(f"{name}_raw"), once(_tokens(template(F.col("plain")))).alias(f"{name}_kind"))

    met_docs = docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi")  # before their texts are rewritten again
    met = near.join(tokens(met_docs, "doc_id", "doc"), ["doc_id", "form"]).join(tokens(items, "item_id", "item"), ["item_id", "form"])
    at = F.explode(F.sequence("begin", F.col("end") - 1)).alias("at")
    met = met.select("doc_id", "item_id", "form", "diagonal", "doc_raw", "doc_kind", "item_raw", "item_kind", at)
    there = F.col("at") + F.col("diagonal")
    pairs = met.select("doc_id", "item_id", "form", "diagonal", F.get("item_kind", F.col("at")).alias("kind"), F.get("doc_kind", there).alias("other"),
                       F.get("item_raw", F.col("at")).alias("value"), F.get("doc_raw", there).alias("stands"))
    pairs = pairs.filter(F.col("kind").isin(*_SLOTS) & (F.col("kind") == F.col("other")))
    pairs = pairs.withColumn("both", once(_different(F.col("value"), F.col("stands"))))
    pairs = pairs.withColumns({"value": F.col("both")["value"], "stands": F.col("both")["stands"]}).drop("both")
    keys = ["doc_id", "item_id", "form", "diagonal"]
    counted = pairs.groupBy(*keys, "kind", "value", "stands").count()
    usual = counted.groupBy(*keys, "kind", "value").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    return usual.groupBy(*keys).agg(F.sum("all").alias("slots"), F.sum("most").alias("agreeing"))


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, literals: int = LITERALS, share: float = SHARE,
          agree: float = AGREE, long: int = LONG) -> DataFrame:
    """(doc_id, item_id, n_windows, total, slots, agreeing): documents that hold most of an item, or a long part."""
    windows = written(item_windows(items, window, literals))
    docs = docs.select("doc_id", "text")
    docs = written(docs.join(written(sifted(docs, windows)), "doc_id", "left_semi"))
    met = meetings(docs, windows).withColumn("diagonal", F.col("place") - F.col("at"))
    near = met.groupBy("doc_id", "item_id", "form", "total", "diagonal").agg(
        F.collect_set("at").alias("places"), F.min("at").alias("begin"), F.max(F.col("at") + F.col("size")).alias("end"))
    near = written(near)
    enough = F.size(F.array_distinct(F.flatten(F.collect_list("places")))) >= share * F.col("total")
    enough = enough | (F.max(F.size("places")) >= long)
    mostly = near.groupBy("doc_id", "item_id", "form", "total").agg(enough.alias("enough")).filter("enough")
    near = written(near.join(mostly.select("doc_id", "item_id", "form"), ["doc_id", "item_id", "form"]))
    slots = _agreement(near, docs, items)
    kept = near.join(slots, ["doc_id", "item_id", "form", "diagonal"], "left").fillna(0, ["slots", "agreeing"])
    kept = kept.filter(F.col("agreeing") >= agree * F.col("slots"))
    held = kept.groupBy("doc_id", "item_id", "form", "total").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("n_windows"),
        F.sum("slots").alias("slots"), F.sum("agreeing").alias("agreeing"), F.max(F.size("places")).alias("longest")).filter(
        (F.col("n_windows") >= share * F.col("total")) | (F.col("longest") >= long))
    first = held.groupBy("doc_id", "item_id").agg(F.min(F.struct("form", "n_windows", "total", "slots", "agreeing")).alias("r"))
    return first.select("doc_id", "item_id", "r.n_windows", "r.total", "r.slots", "r.agreeing")
