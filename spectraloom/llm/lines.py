"""Fuzzy line deduplication, in DataFrame operations only.

Lines are read as words of lower-cased letters and digits; lines of equal words
are one node. Few edits leave most of a line's rarest words (here those of most
bytes, then by hash) alone, so two similar lines have at least two words in
common among the first few of either: pairs of those are the join keys. A small
bucket of a key is paired whole; in a large one every line meets a leader of its
own key. Lines of what is then still apart meet again under their rarest words,
by the counts among such lines: of these similar lines share enough whatever the
edits, while lines that have just a frequent passage in common do not meet. All candidates are verified by their
edit similarity in words. Of each connected group the first occurrence stays, every
other one is removed.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import components, discard, release, stored

#: Words that similar lines have in common to meet.
_COMMON = 2
#: Bits of a word's hash, below its negative length (so that most bytes come first, up to 64 of them).
_HASH_BITS = 57


@dataclass(frozen=True)
class Settings:
    """similarity: least 1 - edits / longer length, in words.

    miss: chance that of the first words of a line too few are left in one of
    just that similarity, edited at random places. Lines that so few
    edits separate that two of these words must be left (of up to 29 words by
    default) always share one.
    pair_bucket: in a larger bucket of a key, lines first meet a leader.
    pair_words: longest lines that meet by pairs of words in what is left.
    """

    similarity: float = 0.9
    miss: float = 5e-3
    pair_bucket: int = 16
    pair_words: int = 64


_GAP = r"[^\p{L}\p{N}]+"


def words_of(raw: str | Column) -> Column:
    """Words of a line; one that begins with a gap has an empty first word, which is dropped."""
    return F.array_remove(F.split(F.lower(raw), _GAP), "")


def _least_words(s: Settings) -> int:
    """Fewest words of a line that may be similar to another."""
    return next(n for n in range(1, 1 << 20) if any(m - n <= (allowed := int(m * (1 - s.similarity) + 1e-9)) and allowed > 0 for m in range(n, 2 * n + 2)))


def _most_edits(n: int | Column, s: Settings):
    """Most edits between a line of n words and any similar one."""
    edits = n * ((1 - s.similarity) / s.similarity) + 1e-6
    return F.floor(edits).cast("int") if isinstance(n, Column) else int(edits)


def _enough(kept: float, miss: float) -> int:
    """The least m such that of m items, each left with chance ``kept``, fewer than two are left with a chance of at most ``miss``."""
    return next(m for m in range(_COMMON, 1 << 20) if (1 - kept) ** m + m * kept * (1 - kept) ** (m - 1) <= miss)


def _first_words(s: Settings) -> int:
    """Of a line's rarest words, so many make its keys."""
    return _enough(s.similarity, s.miss)


def _pairs_of(items: str, most: int) -> Column:
    """Hashes of all pairs of the first ``most`` of the distinct ``items``; if these are fewer, of each of them, too. Nulls fill the rest."""
    at = lambda i: F.get(items, F.lit(i))
    both = [F.when(F.size(items) > j, F.xxhash64(at(i), at(j))) for i, j in combinations(range(most), _COMMON)]
    one = [F.when((F.size(items) > i) & (F.size(items) < most), F.xxhash64(at(i))) for i in range(most - 1)]
    return F.array(*both, *one)


def lines(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, cls, line (from 0), h, n (words), first of each line with a letter or digit.

    cls is a hash of the whole text and h one of the line's words. first has
    the codes of the line's rarest words; it is null for a line of so few words
    that no edit is allowed, which has no similar lines.
    """
    code = lambda w: F.shiftleft(-F.octet_length(w).cast("long"), _HASH_BITS) + F.shiftrightunsigned(F.xxhash64(w), 64 - _HASH_BITS)
    coded = lambda raw: F.array_remove(F.transform(F.split(raw, _GAP), code), code(F.lit("")))
    # A text is lower-cased at once, and the words of all its lines are coded before lines become rows, so that a filter on rows codes none again.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("cls"), F.posexplode(F.transform(F.split(F.lower("text"), "\n", -1), coded)).alias("line", "words"))
    most = _first_words(s)
    first = F.when(F.size("words") >= _least_words(s), F.slice(F.array_distinct(F.slice(F.sort_array("words"), 1, 4 * most)), 1, most))
    return rows.filter("size(words) > 0").select("doc_id", "cls", "line", F.xxhash64("words").alias("h"), F.size("words").alias("n"), first.alias("first"))


def _allowed(s: Settings, a: str | Column, b: str | Column) -> Column:
    """Edits that lines of ``a`` and ``b`` words may differ in."""
    return F.floor(F.greatest(a, b) * F.lit(1 - s.similarity) + F.lit(1e-9)).cast("int")


def _near(s: Settings, a: str, b: str) -> Column:
    """Lengths, in columns ``a`` and ``b``, that similar lines may have."""
    return F.abs(F.col(a) - F.col(b)) <= _allowed(s, a, b)


def _codes(hashes: str) -> Column:
    """A line, given its words' ``hashes``, with each word as one character (a code point of five hexadecimal digits), for edit distances in words."""
    code = lambda x: F.hex(F.pmod(x, F.lit(0xF0000)) + F.lit(0x10000))
    return F.decode(F.unhex(F.concat(F.lit("000"), F.array_join(F.transform(hashes, code), "000"))), "UTF-32")


def _number(doc_id: str = "doc_id") -> Column:
    """The id as a join key: null is the least number."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """h, words (coded), bag (16 bits of each word) of the lines at ``places`` (h, id, cls, line), each h once; only their documents' lines are read."""
    wanted = places.groupBy("id", "cls").agg(F.collect_list(F.struct("line", "h")).alias("at"))
    # What is wanted is hashed, so that no text is sorted; of rows that repeat id and text only the lines at places are compared.
    met = docs.select(_number().alias("id"), F.xxhash64("text").alias("cls"), "text").join(wanted.hint("shuffle_hash"), ["id", "cls"])
    rows = met.select("id", "cls", F.split("text", "\n", -1).alias("parts"), "at").select("id", "cls", "parts", F.explode("at").alias("p"))
    rows = rows.select("id", "cls", F.col("p.h").alias("h"), F.get("parts", F.col("p.line")).alias("raw")).dropDuplicates(["id", "cls", "h"])
    rows = rows.select("h", F.transform(words_of("raw"), lambda w: F.xxhash64(w)).alias("hashes"))
    return rows.select("h", _codes("hashes").alias("words"), F.transform("hashes", lambda x: F.shiftright(x, 48).cast("short")).alias("bag"))


def _similar(s: Settings, wa: str, wb: str, bags: tuple[str, str] | None = None) -> Column:
    """Whether two coded lines are similar. Each word of one that the other's bag has not needs an edit, so ``bags`` settle most of those that are not."""
    most = _allowed(s, F.length(wa), F.length(wb))
    near = F.abs(F.length(wa) - F.length(wb)) <= most
    if bags:
        near &= F.size(F.array_except(*bags)) <= most
    # The function gives -1 beyond ``most``; a filter would compute it again for each further mention.
    return F.when(near, F.call_function("levenshtein", F.col(wa), F.col(wb), most) >= 0).otherwise(False)


def verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Those of ``pairs`` (a, b) of line hashes whose ``texts`` (h, words, bag if there is one) reach the edit similarity."""
    x, y = (texts.withColumnsRenamed({"h": x, "words": f"w{x}", "bag": f"bag{x}"}) for x in ("a", "b"))
    bags = ("baga", "bagb") if "bag" in texts.columns else None
    return pairs.join(x, "a").join(y, "b").filter(_similar(s, "wa", "wb", bags)).select("a", "b")


def _in_order(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _led(rows: DataFrame) -> DataFrame:
    """Pairs of the lines of ``rows`` (key, h) with the leader of their key, which differs from key to key."""
    leads = rows.groupBy("key").agg(F.min(F.col("h").bitwiseXOR(F.col("key"))).alias("m"))
    met = rows.join(leads, "key").withColumn("lead", F.col("m").bitwiseXOR(F.col("key"))).filter("h <> lead")
    return met.select(*_in_order(F.col("h"), F.col("lead")))


def _grouped(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) of ``label`` after ``links`` between its components or new ids."""
    if label is None:
        return stored(components(links))
    known = label.select(F.col("id").alias("k"), F.col("component").alias("c"))
    for end in ("a", "b"):
        links = links.join(known, F.col(end) == F.col("k"), "left").withColumn(end, F.coalesce("c", end)).drop("k", "c")
    more = stored(components(links.filter("a <> b")))
    new = more.select(F.col("id").alias("k"), F.col("component").alias("c"))
    moved = label.join(new, F.col("component") == F.col("k"), "left").select("id", F.coalesce("c", "component").alias("component"))
    return stored(moved.union(more.join(label, "id", "left_anti")))


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with the component of h, itself where it has no link; only keys with more than one component."""
    rows = rows.drop("component").join(label.withColumnRenamed("id", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    apart = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return rows.join(apart.select("key"), "key", "left_semi")


def _rarest(texts: DataFrame, s: Settings) -> DataFrame:
    """h, n, subs of lines: hashes that similar lines of ``texts`` share one of, whatever the edits.

    Of the distinct words, in order of their counts among these lines, the first
    k + 2 of lines at most k edits apart have two in common: a line of up to
    ``pair_words`` words (and as many more as similar ones may have) has their
    pairs, and if they are fewer each word. A longer one has the first 2k + 1 of
    its runs of two words, of which an edit destroys two.
    """
    rows = texts.select("h", F.length("words").alias("n"), F.split("words", "").alias("w"))
    short, long = F.col("n") <= s.pair_words / s.similarity, F.col("n") >= s.pair_words
    runs = F.transform(F.sequence(F.lit(0), F.col("n") - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))
    kinds = [F.when(short, F.struct(F.lit(True).alias("words"), F.transform("w", lambda x: F.xxhash64(x)).alias("of"))), F.when(long, F.struct(F.lit(False).alias("words"), runs.alias("of")))]
    rows = rows.select("h", "n", F.inline(F.array_compact(F.array(*kinds))))
    rows = stored(rows.select("h", "n", "words", F.explode(F.array_distinct("of")).alias("item")))
    counts = rows.groupBy("words", "item").agg(F.count("*").alias("c"))
    counted = rows.join(counts.hint("shuffle_hash"), ["words", "item"])
    found = counted.groupBy("h", "n", "words").agg(F.sort_array(F.collect_list(F.struct("c", "item"))).alias("all"))
    most = _most_edits(F.col("n"), s)
    found = found.select("h", "n", "words", F.transform(F.slice("all", F.lit(1), F.when(F.col("words"), most + 2).otherwise(2 * most + 1)), lambda x: x["item"]).alias("first"), most.alias("most"))
    both = F.flatten(F.transform("first", lambda x, i: F.transform(F.slice("first", i + 2, F.size("first")), lambda y: F.xxhash64(x, y))))
    subs = F.when(~F.col("words"), F.col("first")).when(F.size("first") < F.col("most") + 2, F.concat(both, "first")).otherwise(both)
    subs = stored(found.select("h", "n", subs.alias("subs")).groupBy("h", "n").agg(F.flatten(F.collect_list("subs")).alias("subs")))
    discard(rows)
    return subs


def _across(rows: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Similar pairs (a, b) of different components that share a key of ``rows`` (key, h, n, component, subs).

    In each key only lines outside its largest component are compared, with all
    others; of the keys that a pair shares, the least one counts. Texts are
    compared where the lines meet, so that no pair travels to its texts.
    """
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    rows = stored(rows.join(main, "key").join(texts, "h"))
    side = lambda df, x: df.select(*(F.col(c).alias(c + x) for c in ("key", "h", "n", "component", "subs", "main", "words", "bag")))
    once = F.array_min(F.array_intersect("subsx", "subsy")) == F.col("keyx")
    meet = (F.col("keyx") == F.col("keyy")) & (F.col("componentx") != F.col("componenty")) & ((F.col("componenty") == F.col("mainx")) | (F.col("hx") < F.col("hy")))
    met = side(rows.filter("component <> main"), "x").join(side(rows, "y"), meet & _near(s, "nx", "ny") & once & _similar(s, "wordsx", "wordsy", ("bagx", "bagy")))
    links = stored(met.select(*_in_order(F.col("hx"), F.col("hy"))).distinct())
    discard(rows)
    return links


def _groups(docs: DataFrame, wide: DataFrame, s: Settings) -> DataFrame:
    """(id, component) of the lines of ``wide`` that have a link, by verified pairs."""
    rows = wide.filter("first is not null").select("h", "n", F.explode(_pairs_of("first", _first_words(s))).alias("key")).filter("key is not null")
    # Nearly every key is alone, so sums before the shuffle would save nothing. Rows travel once: n is asked for on both ways, so that they share the shuffle.
    rows = rows.repartition("key")
    common = rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("n").alias("most")).filter("lo < hi and most > 0").select("key")
    shared = stored(rows.join(common.hint("shuffle_hash"), "key").distinct())
    release(docs.sparkSession)
    sized = shared.join(shared.groupBy("key").agg(F.count("*").alias("c")), "key")
    small, large = sized.filter(F.col("c") <= s.pair_bucket), stored(sized.filter(F.col("c") > s.pair_bucket).select("key", "h"))
    side = lambda x: small.select(F.col("key").alias(f"k{x}"), F.col("h").alias(x), F.col("n").alias(f"n{x}"))
    pairs = side("a").join(side("b"), (F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")) & _near(s, "na", "nb")).select("a", "b")
    pairs = stored(pairs.union(_led(large)).distinct())
    ids = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    places = wide.select("h", _number().alias("id"), "cls", "line").join(ids, "h").dropDuplicates(["h"])
    texts = stored(_texts(docs, places))
    release(docs.sparkSession)
    label = _grouped(None, verified(pairs, texts, s))
    hot = stored(_labelled(large, label).select("h").distinct())
    if not hot.isEmpty():
        subs = _rarest(texts.join(hot, "h", "left_semi"), s)
        finer = stored(_labelled(subs.select("h", "n", F.explode("subs").alias("key")), label))
        label = _grouped(label, verified(_led(finer).distinct(), texts, s))
        left = stored(_labelled(finer, label).join(subs.select("h", "subs"), "h"))
        if not left.isEmpty():
            label = _grouped(label, _across(left, texts, s))
        discard(subs, finer, left)
    discard(shared, large, pairs, texts, hot)
    return label


def removed_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, cls, gone (array of line numbers, ascending) of each document that loses lines.

    Of each group of lines (of equal words, or connected by similar pairs) the
    occurrence of smallest doc_id (null first), then hash of the text, then
    line, stays. The texts are read once for all lines' hashes, and once more
    for the candidates' words.
    """
    s = settings
    wide = stored(lines(docs, s))
    release(docs.sparkSession)
    label = _groups(docs, wide, s)
    number = _number().alias("id")
    seen = wide.groupBy("h").agg(F.min(number).alias("first"), F.count("*").alias("n"))
    # A line that occurs once and has no link is alone in its group.
    every = seen.join(label.withColumnRenamed("id", "h"), "h", "left").filter("n > 1 or component is not null")
    every = stored(every.withColumn("component", F.coalesce("component", "h")))
    repeated = every.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("all")).filter("all > 1")
    met = wide.select("doc_id", "cls", "line", "h", number).join(every.join(repeated, "component").select("h", "component", "keep"), "h")
    met = stored(met.select("doc_id", "cls", "line", "component", (F.col("id") == F.col("keep")).alias("home")))
    place = F.struct("cls", "line")
    kept = met.filter("home").groupBy("component").agg(F.min(place).alias("at"))
    gone = met.join(kept, "component").filter(~F.col("home") | (place != F.col("at")))
    gone = stored(gone.groupBy("doc_id", "cls").agg(F.array_sort(F.collect_set("line")).alias("gone")))
    discard(wide, label, every, met)
    return gone


def _cut(docs: DataFrame, settings: Settings) -> DataFrame:
    """The columns of ``docs``, text less its removed lines, __n_lines, __n_removed."""
    gone = removed_lines(docs, settings).select(_number().alias("__gone_id"), F.col("cls").alias("__gone_cls"), F.col("gone").alias("__gone"))
    rows = docs.select("*", _number().alias("__id"), F.xxhash64("text").alias("__cls"))
    found = rows.join(gone.hint("shuffle_hash"), (F.col("__cls") == F.col("__gone_cls")) & (F.col("__id") == F.col("__gone_id")), "left")
    # Only a text that loses lines is cut, and once: the outer lambda holds its lines.
    less = lambda cut: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("__gone")), lambda i: F.get(cut, i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(F.split("text", "\n", -1)), less), F.lit(0)))
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines, n_removed = F.coalesce(feeds + 1, F.lit(0)).cast("long"), F.greatest(F.lit(0), F.coalesce(F.size("__gone"), F.lit(0))).cast("long")
    return found.select(*(text.alias(c) if c == "text" else c for c in docs.columns), n_lines.alias("__n_lines"), n_removed.alias("__n_removed"))


def deduplicate(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``text`` less its removed lines, and n_lines, n_removed.

    Lines end at a line feed. Lines without a letter or digit stay, as does a
    null text (no lines). A line is known by its document's id and text: rows
    that repeat an id with another text keep lines of their own, rows that
    repeat both are one document. A null doc_id is an id. A line of any length
    is one. All columns of ``docs`` stay, but input columns of the names n_lines
    and n_removed give way; an empty table stays empty. Nodes are told apart by
    64-bit hashes.
    """
    done = _cut(docs, settings)
    return done.select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")), F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


def without_repeated_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without repeated lines, same columns; a document that lost all lines with a letter or digit is dropped."""
    done = _cut(docs, settings).filter((F.col("__n_removed") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    return done.select(*docs.columns)
