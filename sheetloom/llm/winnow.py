"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words are hashed, every run of GRAM consecutive words gets a hash of its own from theirs, and of every WINDOW consecutive runs the one with the
least hash is picked, the rightmost of equal ones. So two texts that share GRAM + WINDOW - 1 consecutive words share a pick, wherever those stand,
and picks keep their position. The next document's beginning comes to a document by its place in the order of ids: only that beginning and
the next one's picks travel, beside one exchange of the texts that both joins use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered
from .shared import materialize

GRAM, WINDOW = 5, 8
#: Scripts that are written without spaces: a character is a word there.
UNSPACED = r"฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\x{20000}-\x{3FFFF}"
WORD = rf"[^\x20\x09-\x0D{UNSPACED}]++|[{UNSPACED}]"
PICKS = "array<struct<h:bigint,at:int>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: as a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def _upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gram_hashes(text: Column, gram: int = GRAM) -> Column:
    """The hash of every run of ``gram`` words; of a shorter text, one of all its words; none without words."""

    def grams(words):
        n = F.size(words)
        each = F.transform(_upto(n - gram + 1), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(gram)]))
        return F.when(n >= gram, each).when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.aggregate(words, F.lit(42).cast("long"), lambda a, w: F.xxhash64(a, w))))

    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0), lambda w: F.xxhash64(w))
    return _let(words, grams)


def _window_least(hashes: Column, window: int, use) -> Column:
    """``use`` of the least hash of every window of a text with at least that many: least of two, four and so on, then of two that overlap."""
    beside = lambda a, step: F.transform(_upto(F.size(a) - step), lambda i: F.least(F.get(a, i), F.get(a, i + step)))

    def wider(a, width):
        if width == window:
            return use(a)
        step = min(width, window - width)
        return _let(beside(a, step), lambda b: wider(b, width + step))

    return wider(hashes, 1)


def picks(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """What winnowing picks of a text: hash and position (number of the run's first word), in order.

    The window after picks the same unless its own last hash is its least, or the pick before has left it.
    """

    def last_of(part, h, end):
        return end - F.array_position(F.reverse(part), h).cast("int")

    def chosen(hashes):
        def moves(least):
            def at(h, i):
                end = i + window
                left = (i == 0) | (F.get(least, i - 1) != h)
                return F.when(F.get(hashes, end - 1) == h, end - 1).when(left, last_of(F.slice(hashes, i + 1, F.lit(window)), h, end)).otherwise(-1)

            return F.filter(F.transform(least, at), lambda x: x >= 0)

        n = F.size(hashes)
        only = F.array(last_of(hashes, F.array_min(hashes), n))
        places = F.when(n >= window, _window_least(hashes, window, moves)).when(n > 0, only).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda x: F.struct(F.get(hashes, x).alias("h"), x.alias("at")))

    return _let(gram_hashes(text, gram), chosen).cast(PICKS)


def hashes_of(found: Column) -> Column:
    """The set of a fingerprint's hashes."""
    return F.array_distinct(F.transform(found, lambda x: x["h"]))


def as_text(found: Column) -> Column:
    """A fingerprint as text: each pick's hash in 16 hex digits, a colon and its position."""
    return F.array_join(F.transform(found, lambda x: F.concat(F.lower(F.lpad(F.hex(x["h"]), 16, "0")), F.lit(":"), x["at"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id and picks of every row, repeated rows and null texts (no picks) included."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), picks(F.coalesce(F.col("text").cast("string"), F.lit("")), gram, window).alias("picks"))


def shared_passages(prints: DataFrame) -> DataFrame:
    """h and every (doc_id, at) where it was picked, for hashes picked in more than one document: an inverted index's rows, not its pairs.

    Documents are counted first, so what is in one document only never travels with its positions.
    """
    each = materialize(prints.select("doc_id", F.inline("picks")).where("doc_id is not null"), "picks")
    common = each.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select(F.col("h").alias("of_h"))
    return each.join(common, F.col("h") == F.col("of_h")).select("h", "doc_id", "at")


def _keyed(docs: DataFrame) -> DataFrame:
    """key, which names a document's id and text, doc_id, and the text without nulls."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.hex(F.xxhash64(text)), F.octet_length(text).cast("string"))
    return docs.select(key.alias("key"), doc_id.alias("doc_id"), text.alias("text"))


def edited_fingerprints(docs: DataFrame, part: int = 4, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last ``1 / part`` of code points (rounded down) replaced by the first as many of the next document's text, or all of it; next in
    ascending doc_id, and the first after the last. A null id comes first, rows with the same id go by their text's hash, and a repeated
    row's next document is its own copy. A null text is empty; texts without words have empty fingerprints, which are alike to one another (1) and to no other (0).
    An empty table gives an empty table, and further columns don't count.
    """
    keyed = _keyed(docs)
    rows = materialize(keyed.select("key", "doc_id", F.length("text").alias("n_chars")), "document-keys")
    placed = materialize(numbered(rows, [F.asc_nulls_first("doc_id"), F.col("key")], name="documents"), "documents")
    following = placed.select(((F.col("i") + F.col("n") - 1) % F.col("n")).alias("of"), F.col("key").alias("next_key"))
    asked = placed.join(following, F.col("i") == F.col("of")).select("key", "doc_id", "n_chars", "next_key")
    asked = materialize(asked.groupBy("key", "doc_id", "n_chars", "next_key").agg(F.count("*").cast("int").alias("copies")), "asked")
    texts = keyed.select("key", "text")
    if not placed.groupBy("key").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["key"])
    head = F.floor(F.col("n_chars") / part).cast("int")
    given = asked.select(F.col("key").alias("for"), F.col("next_key").alias("of_next"), "doc_id", "n_chars", "copies", head.alias("head")).join(texts, F.col("of_next") == F.col("key"))
    given = given.select("for", "doc_id", "n_chars", "copies", "head", F.substr("text", F.lit(1), F.col("head")).alias("tail"), hashes_of(picks(F.col("text"), gram, window)).alias("next_hashes"))
    met = given.join(texts, F.col("for") == F.col("key"))
    met = met.select("doc_id", "n_chars", "copies", "text", F.concat(F.substr("text", F.lit(1), F.col("n_chars") - F.col("head")), F.col("tail")).alias("edited"), "next_hashes")
    met = met.select("doc_id", "n_chars", "copies", F.sha2("edited", 256).alias("edited_sha256"), picks(F.col("text"), gram, window).alias("own"), picks(F.col("edited"), gram, window).alias("changed"), "next_hashes")
    met = met.withColumns({"hashes": hashes_of(F.col("own")), "changed_hashes": hashes_of(F.col("changed"))})
    out = met.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("changed_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"), "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")
