"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units after them and names (capitalised words inside a sentence) become typed placeholders, so that a question
with other parameters has the same template. Windows of a template's words are hashed and joined with the windows of
the benchmark. On the documents that match, placeholders are filled again: in a run of windows of one alignment, each value
of the item must stand for one value of the document. A clash ends the run and takes no other windows with it, and two
values of the item may have become the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemark.llm.common import materialise

WINDOW = 8
MIN_LITERALS = 5
SHORTEST = 3  # default of the functions; the queries search items of any length
BROADCAST_WINDOWS = 1_000_000
NUM, UNIT, NAME, JOINED = "\ue000", "\ue001", "\ue002", "\ue003"
MARKS = NUM + UNIT + NAME + JOINED
# repeated groups are possessive: nothing needs them to give back, and a greedy one takes a frame of the stack for each round, so that some
# thousand names, numbers or separators in a row overflow it
# fixed values: unit words, as they stand after a number (a capitalised one is a name by its form, and so a slot too)
UNITS = """km m cm mm mi miles mile kg g mg lb lbs tons ton l ml litres liters hours hour h minutes minute min seconds second s days day weeks week months
month years year dollars dollar euros euro cents cent percent mph kmh meters metres meter kilometers kilometres feet foot inches inch yards degrees
heures heure secondes jours semaines mois ans litres mètres kilomètres grammes pourcent
horas hora minutos segundos días semanas meses años metros kilómetros gramos litros
ore minuti secondi giorni settimane mesi anni metri chilometri grammi litri
км м см кг г л часов часа минут секунд дней недель лет рублей метров километров""".split()
SEPARATORS = rf"(?:[^\p{{L}}\p{{N}}.,{MARKS}]|(?<!\p{{N}})[.,]|[.,](?!\p{{N}}))++"
# fixed values: the blocks of scripts without spaces (Thai to Myanmar, Khmer, kana, Han); each character is a word
SPACELESS = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3041-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}&&\p{L}]"
BETWEEN = rf"[^\p{{L}}{NUM}{UNIT}{NAME}]+"  # once all numbers are placeholders
BEFORE_NAME = r"[\p{Ll}\p{N},;:]"  # what stands, with a space, before a name: not the end of a sentence
NAMED = rf"\p{{Lu}}(?<={BEFORE_NAME} .)\p{{Ll}}+(?:{JOINED}\p{{Lu}}\p{{Ll}}+(?![\p{{L}}\p{{N}}]))*+(?![\p{{L}}\p{{N}}])"
NAME_GAP = rf" (?=\p{{Lu}}\p{{Ll}}+(?![\p{{L}}\p{{N}}]))(?<={BEFORE_NAME} \p{{Lu}}\p{{Ll}}{{1,40}} )"


def plain(text: Column) -> Column:
    """A text without marks of this module, and with spaces round the characters of scripts without any."""
    held = F.lit(False)
    for mark in MARKS:
        held = held | text.contains(mark)
    text = F.when(held, F.regexp_replace(text, f"[{MARKS}]", " ")).otherwise(text)
    return F.when(text.rlike(SPACELESS), F.regexp_replace(text, f"({SPACELESS})", " $1 ")).otherwise(text)


def join_names(text: Column) -> Column:
    """A plain text in which a name of several words is one: their spaces are marks."""
    return F.regexp_replace(text, NAME_GAP, JOINED)


def split_words(text: Column) -> Column:
    """Words of letters and digits of a plain text; a number keeps its inner points and commas, and letters after digits
    are a word."""
    return F.array_remove(F.split(F.regexp_replace(text, r"(?<=\p{N})(?=\p{L})", " "), SEPARATORS), "")


def canonical_words(text: Column) -> Column:
    """The same words of a text with joined names, with placeholders, the others in lower case. Texts without digits,
    most of them, take a short way."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"(?<=\p{N})(?=\p{L})", " "), NAMED, NAME)
    numbers = F.regexp_replace(spaced, r"\p{N}+(?:[.,]\p{N}+)*+", NUM)
    units = F.regexp_replace(numbers, rf"(?<={NUM} )(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", UNIT)
    return F.array_remove(F.split(F.lower(F.when(text.rlike(r"\p{N}"), units).otherwise(F.regexp_replace(text, NAMED, NAME))), BETWEEN), "")


def is_slot(word: Column) -> Column:
    return word.isin(NUM, UNIT, NAME)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _windows(hashes: Column, size: int) -> Column:
    """Of every window of size words its hash, in order; none if there are fewer words. The array is bound to a name: its
    expression would be worked out for every element else."""
    def of(hs):
        return F.when(F.size(hs) >= size, F.transform(F.sequence(F.lit(0), F.size(hs) - size), lambda i: F.xxhash64(*[F.get(hs, i + j) for j in range(size)])))
    return F.transform(F.array(hashes), of)[0]


def benchmark_items(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, ik, variant, shift, ic, iw, iu) of every item with words; ik tells apart texts of one id. ic are the words with
    placeholders, iw those that stand for them, iu all words. A name at an item's start cannot be told from the capital
    of a sentence, so such an item is there in both readings; in the second, the first shift + 1 words are one name."""
    items = bench.filter(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    items = items.withColumns({"ik": F.xxhash64("text"), "plain": plain(F.col("text"))}).withColumn("joined", join_names(F.col("plain")))
    items = items.withColumns({"ic": canonical_words(F.col("joined")), "iw": split_words(F.col("joined")), "iu": split_words(F.col("plain"))}).filter(F.size("ic") > 0)
    items = items.withColumn("capital", F.regexp_extract("text", r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", 0) != "")
    items = items.withColumn("shift", F.when(F.get("ic", F.lit(1)) == NAME, 1).otherwise(0))
    first = F.array_join(F.slice("iw", F.lit(1), F.col("shift") + 1), JOINED)
    other = items.filter("capital").select("item_id", "ik", F.lit(1).alias("variant"), "shift", F.concat(F.array(F.lit(NAME)), F.slice("ic", F.col("shift") + 2, F.size("ic"))).alias("ic"),
                                           F.concat(F.array(first), F.slice("iw", F.col("shift") + 2, F.size("iw"))).alias("iw"), "iu")
    return items.select("item_id", "ik", F.lit(0).alias("variant"), F.lit(0).alias("shift"), "ic", "iw", "iu").unionByName(other)


def benchmark_windows(items: DataFrame, window: int, min_literals: int, shortest: int) -> DataFrame:
    """(item_id, ik, variant, exact, from, at, size, h, n_windows) of every item. Items of fewer words than window are one
    window. Windows with at least min_literals words besides placeholders are templates. An item with others has all
    windows of its own words too, as exact ones, but for items of fewer words than shortest. from is the window's first
    word in its reading, at that in the first reading. n_windows counts the item's windows of the same kind."""
    def spread(rows, words, last):
        size = F.least(F.size(words), F.lit(window))
        return rows.withColumn("size", size).withColumn("from", F.explode(F.sequence(F.lit(0), F.when(last, F.size(words) - F.col("size")).otherwise(0))))
    rows = spread(items, "ic", F.col("variant") == 0)
    part = F.slice("ic", F.col("from") + 1, F.col("size"))
    rows = rows.withColumns({"part": part, "template": F.size(F.filter(part, lambda w: ~is_slot(w))) >= min_literals})
    templates = rows.filter("template").select("item_id", "ik", "variant", F.lit(False).alias("exact"), "from", (F.col("from") + F.col("shift")).alias("at"), "size", _windows_of("part", window).alias("h"))
    short = rows.filter(~F.col("template") & (F.col("variant") == 0)).select("item_id", "ik", "variant", "iu").distinct().filter(F.size("iu") >= shortest)
    exact = spread(short, "iu", F.lit(True)).withColumn("part", F.slice("iu", F.col("from") + 1, F.col("size")))
    exact = exact.select("item_id", "ik", "variant", F.lit(True).alias("exact"), "from", F.col("from").alias("at"), "size", _windows_of("part", window).alias("h"))
    both = templates.unionByName(exact).distinct()
    return both.join(both.groupBy("ik", "exact").agg(F.count_distinct("at").alias("n_windows")), ["ik", "exact"])


def _windows_of(part: str, window: int) -> Column:
    """The hash of one window of at most `window` words, as _windows gives it."""
    out = F
    for size in range(1, window + 1):
        out = out.when(F.size(part) == size, _windows(_hashes(F.col(part)), size)[0])
    return out


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", window: int = WINDOW, min_literals: int = MIN_LITERALS, min_windows: int = 1,
          shortest: int = SHORTEST) -> DataFrame:
    """(id_col, text_hash, item_col, n_windows, item_windows, n_slots): one row for each document and item that it leaks.

    n_windows are the item's windows found in one run of an alignment that agrees in its values (the best), n_slots the
    different placeholder values in it. Windows with fewer than min_literals words besides placeholders are found as
    exact copies (but for case) and count by themselves; items with fewer words than shortest are then left out.
    Null and empty texts leak nothing. Rows with one id and different texts are told apart by text_hash; equal rows give
    one; a null id is an id like others. Equal alignments fall to the first in the text. Empty tables give an empty
    table. The search runs when this is called.
    """
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tk", F.xxhash64("text"))
    items = materialise(benchmark_items(bench, item_col, item_text_col), "items")
    marks = materialise(benchmark_windows(items, window, min_literals, shortest), "marks")
    kinds = sorted((r["exact"], r["size"]) for r in marks.select("exact", "size").distinct().collect()) or [(False, window)]
    words = {False: canonical_words(F.col("joined")), True: split_words(F.col("plain"))}
    keyed = rows.withColumn("plain", plain(F.col("text"))).withColumn("joined", join_names(F.col("plain"))).select("id", "tk", *[_hashes(words[e]).alias(f"hashes_{e}") for e in sorted({e for e, _ in kinds})])
    # (outer: the filter that Spark infers for the other form would work out all windows once more)
    if len(kinds) == 1:
        e, size = kinds[0]
        spots = keyed.select("id", "tk", F.lit(e).alias("exact"), F.lit(size).alias("size"), F.posexplode_outer(_windows(F.col(f"hashes_{e}"), size)).alias("pos", "h"))
    else:
        all_kinds = F.array(*[F.struct(F.lit(e).alias("exact"), F.lit(s).alias("size"), _windows(F.col(f"hashes_{e}"), s).alias("hs")) for e, s in kinds])
        spots = keyed.select("id", "tk", F.explode_outer(all_kinds).alias("w")).select("id", "tk", F.col("w.exact").alias("exact"), F.col("w.size").alias("size"), F.posexplode_outer("w.hs").alias("pos", "h"))
    held = F.broadcast(marks) if marks.count() <= BROADCAST_WINDOWS else marks
    hits = spots.join(held, ["h", "size", "exact"]).select("id", "tk", "item_id", "ik", "variant", "exact", "pos", "from", "at", "size", F.col("n_windows").alias("item_windows")).distinct()
    hits = materialise(hits, "hits")  # few rows, read twice below

    # the words of the documents and items that met, to compare in full and to fill the placeholders; they are written, since a
    # join would work them out again for each of a document's hits
    met = materialise(hits.select(F.col("id").alias("mid"), F.col("tk").alias("mtk")).distinct(), "met")
    met = F.broadcast(met) if met.count() <= BROADCAST_WINDOWS else met
    found = rows.join(met, rows["id"].eqNullSafe(met["mid"]) & (rows["tk"] == met["mtk"]), "left_semi").dropDuplicates(["id", "tk"])
    found = found.withColumn("plain", plain(F.col("text"))).withColumn("joined", join_names(F.col("plain"))).select(
        F.col("id").alias("did"), F.col("tk").alias("dtk"), canonical_words(F.col("joined")).alias("dc"), split_words(F.col("joined")).alias("dw"), split_words(F.col("plain")).alias("du"))
    found = materialise(found, "words")
    items = items.select(F.col("item_id").alias("iid"), F.col("ik").alias("iik"), F.col("variant").alias("iv"), "ic", "iw", "iu")

    def cut(words, exact_words, at):
        return F.slice(F.when(F.col("exact"), F.col(exact_words)).otherwise(F.col(words)), F.col(at) + 1, F.col("size"))
    # a written table of hits is many times smaller than its rows in memory, so its size must not choose a broadcast; and of a
    # document's words only the window's go on
    full = hits.hint("merge").join(found, hits["id"].eqNullSafe(found["did"]) & (hits["tk"] == found["dtk"]))
    full = full.select(*hits.columns, cut("dc", "du", "pos").alias("a"), cut("dw", "du", "pos").alias("x"))
    full = full.join(items, F.col("item_id").eqNullSafe(F.col("iid")) & (F.col("ik") == F.col("iik")) & (F.col("variant") == F.col("iv")))
    full = full.withColumns({"b": cut("ic", "iu", "from"), "y": cut("iw", "iu", "from")})
    # equal words, and not equal hashes only
    full = full.filter(F.transform("a", F.lower) == F.transform("b", F.lower))
    slot = F.transform("a", lambda w, i: F.when(is_slot(w) | (F.col("exact") & w.rlike(r"^\p{N}")), F.struct(
        F.when(F.col("exact"), NUM).otherwise(w).alias("kind"), F.lower(F.get("y", i)).alias("item"), F.lower(F.get("x", i)).alias("doc"))))
    full = full.withColumn("pairs", F.filter(slot, lambda p: p.isNotNull()))
    line = ["id", "tk", "item_id", "ik", "exact", "line"]
    wins = full.select("id", "tk", "item_id", "ik", "exact", (F.col("pos") - F.col("at")).alias("line"), "item_windows", "at", F.array_distinct("pairs").alias("pairs"))
    # a window that clashes in itself goes alone
    wins = wins.filter(F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p["item"])))) == F.size("pairs")).distinct()
    wins = wins.withColumn("nth", F.dense_rank().over(Window.partitionBy(*line).orderBy("at")))
    # the last window before each that has another value for one of its own: runs that agree begin after it
    held = Window.partitionBy(*line, "p.kind", "p.item").orderBy("nth", "p.doc")
    slots = wins.withColumn("p", F.explode_outer("pairs")).withColumns({"last_doc": F.lag("p.doc").over(held), "last_nth": F.lag("nth").over(held)})
    clashes = slots.groupBy(*line, "item_windows", "nth", "pairs").agg(F.max(F.when(F.col("last_doc") != F.col("p.doc"), F.col("last_nth"))).alias("clash"))
    so_far = Window.partitionBy(*line).orderBy("nth").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    runs = clashes.withColumn("n", F.col("nth") - F.coalesce(F.max("clash").over(so_far), F.lit(0)))
    runs = runs.withColumn("top", F.max(F.struct("n", (-F.col("nth")).alias("end"))).over(Window.partitionBy(*line)))
    runs = runs.filter((F.col("nth") <= -F.col("top.end")) & (F.col("nth") > -F.col("top.end") - F.col("top.n")))
    lines = runs.groupBy(*line).agg(F.max("item_windows").alias("item_windows"), F.max("top.n").cast("long").alias("n_windows"),
                                    F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("slots"))
    good = lines.filter(F.col("n_windows") >= min_windows)
    best = good.groupBy("id", "tk", "item_id").agg(F.max(F.struct("n_windows", -F.col("line"), "item_windows", F.size("slots").alias("n_slots"))).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("tk").alias("text_hash"), F.col("item_id").alias(item_col), F.col("m.n_windows").alias("n_windows"),
                       F.col("m.item_windows").alias("item_windows"), F.col("m.n_slots").cast("long").alias("n_slots"))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of docs that leak no item; null texts stay."""
    found = leaks(docs, bench, id_col, text_col, **how).select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_tk")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_id"]) & (F.xxhash64(docs[text_col].cast("string")) == found["_tk"]), "left_anti")


def op4(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return leaks(docs, bench, shortest=1).select("doc_id", "item_id", "n_windows", "item_windows", "n_slots")
