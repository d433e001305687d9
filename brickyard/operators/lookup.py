"""Price lookup: whole-word matching with ranked, bounded relaxation.

A request's words all have to occur as whole words in a product name. When no row
has them all, the most frequent words without a digit are dropped one at a time,
keeping at least two words.

Words are matched on an index of the distinct products (name, category, unit, region)
with their folded tokens, not on price rows, which repeat a product by manufacturer,
period and document. Equal requests are answered once. Every request joins on two words
that are never dropped (or its only one), so the work is an equi-join on inverted words,
not requests times products; the other words that are never dropped are tested next, and
only then the filters and the drop level. A request's manufacturers are found among the
distinct ones. Of the products at a request's best level, all of which have a row, those
with the k best name scores are joined with the newest k rows of each product, or of each
product of a manufacturer, so that no request meets all rows of a product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickyard.functions.dims import REGION_NAMES
from brickyard.functions.joins import contains_join, small_side
from brickyard.functions.stored import materialize
from brickyard.functions.text import match_words, name_tokens, trigram_similarity, trigrams

MIN_KEPT = 2
RAW_MIN_WORDS = 3


PRODUCT = ["material_name", "material_category", "region", "unit"]


def index(prices: DataFrame) -> DataFrame:
    """The distinct products: their columns, tokens, ``product_id``, number of rows and newest time; store it to look up often."""
    rows = prices.groupBy(*PRODUCT).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.struct("price_period", "created_at")).alias("newest"))
    return rows.withColumns({"name_tokens": name_tokens(F.col("material_name")), "category_tokens": name_tokens(F.col("material_category")), "product_id": F.xxhash64(*PRODUCT)})


def word_frequency(prices: DataFrame) -> DataFrame:
    """(region, word, n): rows whose name holds the word; region null counts all regions."""
    words = prices.select("region", F.explode(name_tokens(F.col("material_name"))).alias("word"))
    by_region = words.groupBy("region", "word").agg(F.count(F.lit(1)).alias("n"))
    return by_region.unionByName(by_region.groupBy("word").agg(F.sum("n").alias("n")).withColumn("region", F.lit(None).cast("string")))


def request_plan(requests: DataFrame, products: DataFrame) -> DataFrame:
    """``requests`` with words, maker_words, pinned, ordered (first dropped first), anchor and required."""
    blank = F.array().cast("array<string>")
    words = lambda c: F.coalesce(F.array_distinct(match_words(F.col(c))), blank)
    own = requests.withColumn("words", words("material_name")).withColumn("maker_words", words("manufacturer"))
    each = own.select("request_id", "region", F.posexplode("words").alias("pos", "word"))
    asked = small_side(each.select("word").distinct(), requests.count())
    known = products.select("region", "n_rows", F.explode("name_tokens").alias("word")).join(asked, "word", "left_semi")
    by_region = known.groupBy("region", "word").agg(F.sum("n_rows").alias("n"))
    freq = by_region.unionByName(by_region.groupBy("word").agg(F.sum("n").alias("n")).withColumn("region", F.lit(None).cast("string"))).withColumnRenamed("region", "of_region")
    counted = each.join(freq, (each.word == freq.word) & each.region.eqNullSafe(freq.of_region), "left").select("request_id", each.word, "pos", F.coalesce("n", F.lit(0)).alias("n"))
    items = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("f"), (-F.length("word")).alias("l"), "pos", "word")))
    plan = counted.groupBy("request_id").agg(items.alias("items"))
    names = lambda cond: F.transform(F.filter("items", cond), lambda x: x["word"])
    plan = plan.select("request_id", names(lambda x: x["word"].rlike("[0-9]")).alias("pinned"), names(lambda x: ~x["word"].rlike("[0-9]")).alias("ordered"))
    out = own.join(plan, "request_id", "left").withColumns({c: F.coalesce(c, blank) for c in ("pinned", "ordered")})
    # the last words of the drop order stay until MIN_KEPT words are left
    stay = F.greatest(F.lit(MIN_KEPT) - F.size("pinned"), F.lit(0))
    out = out.withColumn("required", F.concat("pinned", F.when(F.size("words") >= MIN_KEPT, F.slice("ordered", F.greatest(F.size("ordered") - stay + 1, F.lit(1)), stay)).otherwise(F.col("ordered"))))
    return out.withColumn("anchor", F.coalesce(F.try_element_at("pinned", F.lit(-1)), F.try_element_at("ordered", F.lit(-1))))


OUT = ["request_id", "rank", "tier", "price_id", "material_name", "unit", "price_ex_vat", "price_basis", "source_type", "price_period", "manufacturer", "region", "name_score"]


def _asked(plan: DataFrame) -> DataFrame:
    return plan.select("request_id", F.col("region").alias("asked_region"), F.array_distinct(match_words(F.coalesce("material_category", F.lit("")))).alias("asked_category"), F.col("material_name").alias("asked_name"), F.col("manufacturer").alias("asked_maker"), F.lower("unit").alias("asked_unit"), "exclude", "words", "maker_words", "ordered", "required", "anchor")


def _in_region() -> Column:
    return F.col("asked_region").isNull() | (F.col("asked_region") == F.col("region"))


def _all_in(words: str, tokens: str) -> Column:
    return F.forall(words, lambda w: F.array_contains(tokens, w))


def _passes() -> Column:
    """Region, unit and exclusion filters."""
    lower = F.lower("material_name")
    keep = _in_region() & (F.col("asked_unit").isNull() | F.contains(F.lower("unit"), F.col("asked_unit")))
    return keep & ~F.exists(F.coalesce("exclude", F.array().cast("array<string>")), lambda x: F.contains(lower, F.lower(x)))


def _pairs(tokens: Column) -> Column:
    """Hashes of single words and of two words in either order."""
    ordered = F.array_sort(tokens)
    two = F.transform(ordered, lambda a, i: F.transform(F.slice(ordered, i + 2, F.size(ordered)), lambda b: F.xxhash64(a, b)))
    return F.concat(F.transform(ordered, lambda w: F.xxhash64(w)), F.flatten(two))


def _matches(plan: DataFrame, products: DataFrame, n_requests: int) -> DataFrame:
    """Products that hold the words of a request that are never dropped and pass its filters; few requests are broadcast."""
    # the last two are the rarest
    rarest = F.array_sort(F.slice("required", F.greatest(F.size("required") - 1, F.lit(1)), F.lit(2)))
    key = F.when(F.size(rarest) == 2, F.xxhash64(F.get(rarest, 0), F.get(rarest, 1))).when(F.size(rarest) == 1, F.xxhash64(F.get(rarest, 0)))
    asked = small_side(_asked(plan).withColumn("key", key), n_requests)
    found = products.withColumn("key", F.explode(_pairs(F.col("name_tokens")))).join(asked, "key")
    return found.filter(_all_in("required", "name_tokens")).filter(_passes()).withColumn("scored", F.lit(True))


def _longest(words: Column) -> Column:
    """The first of the longest words."""
    return F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]


MATCH = ["request_id", "product_id", *PRODUCT, "n_rows", "newest", "tier", "need", "scored"]
#: Rows of ids that are broadcast: an id is far smaller than the row that joins count a side at.
BROADCAST_IDS = 500_000


def _same_product(other: str) -> Column:
    """The prices' product is that of the columns with the prefix ``other``."""
    same = F.xxhash64(*PRODUCT) == F.col("product_id")
    for c in PRODUCT:
        same = same & F.col(c).eqNullSafe(F.col(other + c))
    return same


def _same(df: DataFrame, columns: list[str]) -> Column:
    """A key of what ``columns`` hold, 256 bits wide."""
    return F.sha2(F.to_json(F.struct(*[df[c] for c in columns])), 256)


def _once(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different requests, under a key as their request_id, and (request_id, same): the key of each request."""
    keyed = requests.withColumn("same", _same(requests, [c for c in requests.columns if c != "request_id"]))
    return keyed.drop("request_id").dropDuplicates(["same"]).withColumnRenamed("same", "request_id"), keyed.select("request_id", "same")


def _for_all(answers: DataFrame, members: DataFrame) -> DataFrame:
    """``answers`` of the different requests, given to each request."""
    return answers.withColumnRenamed("request_id", "same").join(members, "same").select("request_id", *[c for c in answers.columns if c != "request_id"])


def _latest() -> list[Column]:
    return [F.desc_nulls_last("price_period"), F.desc("created_at"), F.col("price_id")]


def _newest(prices: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` newest rows of each of the keys."""
    order = Window.partitionBy(*keys).orderBy(*_latest())
    return prices.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def _makers(plan: DataFrame, prices: DataFrame) -> DataFrame | None:
    """(request_id, only_maker, own_score): the manufacturers that hold all words of a request's; None if none asks for one."""
    made = plan.filter(F.size("maker_words") > 0).select("request_id", "maker_words", _longest(F.col("maker_words")).alias("anchor"), trigrams(F.col("manufacturer")).alias("maker_grams"))
    n = made.count()
    if not n:
        return None
    makers = prices.select("manufacturer").distinct().withColumn("maker_tokens", name_tokens(F.col("manufacturer"))).withColumn("anchor", F.explode("maker_tokens"))
    found = makers.join(small_side(made, n), "anchor").filter(_all_in("maker_words", "maker_tokens"))
    return materialize(found.select("request_id", F.col("manufacturer").alias("only_maker"), trigram_similarity(trigrams(F.col("manufacturer")), F.col("maker_grams")).alias("own_score")), "lookup-makers")


def _sold(makers: DataFrame, prices: DataFrame, most: int) -> DataFrame:
    """Stored: the newest rows of each product of the asked manufacturers, with their ``place`` and the number of all its rows."""
    names = makers.select("only_maker").distinct()
    rows = prices.join(small_side(names, names.count()), F.col("manufacturer") == F.col("only_maker"), "left_semi")
    return materialize(_newest(rows, [*PRODUCT, "manufacturer"], most), "lookup-sold")


def _sold_products(sold: DataFrame) -> DataFrame:
    return sold.filter("place = 1").select(*PRODUCT, F.col("manufacturer").alias("seller"), F.struct("price_period", "created_at").alias("newest_sold"))


def _free() -> dict[str, Column]:
    return {"only_maker": F.lit(None).cast("string"), "own_score": F.lit(None).cast("double")}


def _by_maker(found: DataFrame, makers: DataFrame | None, sold: DataFrame | None) -> DataFrame:
    """Matches; where a request names a maker, one for each maker that has a row of the product."""
    free = found.filter(F.size("maker_words") == 0).select(*MATCH).withColumns(_free())
    if makers is None:
        return free
    own = found.filter(F.size("maker_words") > 0).select(*[c for c in MATCH if c not in PRODUCT], *[F.col(c).alias(f"of_{c}") for c in PRODUCT])
    own = own.join(small_side(makers, makers.count()), "request_id")
    rows = _sold_products(sold)
    bound = rows.join(own, _same_product("of_") & (F.col("seller") == F.col("only_maker"))).withColumn("newest", F.col("newest_sold"))
    return free.unionByName(bound.select(*free.columns))


def _first(rows: DataFrame) -> DataFrame:
    """The k first of each request."""
    order = Window.partitionBy("request_id").orderBy("tier", "need", F.desc("name_score"), F.desc("maker_score"), *_latest())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("k")).select(*OUT)


def _best(found: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """Stored: the products at a request's best level that can hold one of its k rows, scored by name only where its words were matched."""
    level = F.rank().over(Window.partitionBy("request_id").orderBy("tier", "need"))
    at_best = found.withColumn("level", level).filter("level <= 1")
    grams = plan.select("request_id", "k", trigrams(F.col("material_name")).alias("asked_grams"), F.col("manufacturer").alias("asked_maker"), trigrams(F.col("manufacturer")).alias("maker_grams"))
    named = at_best.join(small_side(grams, plan.count()), "request_id")
    named = named.withColumn("name_score", F.when(F.col("scored"), trigram_similarity(trigrams(F.col("material_name")), F.col("asked_grams"))))
    # every match has a row, so those behind the k best by name, maker and newest row, ties included, cannot count
    newest = F.when(F.col("asked_maker").isNull() | F.col("only_maker").isNotNull(), F.col("newest"))
    order = Window.partitionBy("request_id").orderBy(F.desc("name_score"), F.desc("own_score"), F.desc(newest))
    first = named.withColumn("before", F.rank().over(order)).filter((F.col("before") <= most) & (F.col("before") <= F.col("k")))
    return materialize(first.select("request_id", "k", "product_id", "tier", "need", "name_score", "only_maker", "own_score", "asked_maker", "maker_grams", *[F.col(c).alias(f"of_{c}") for c in PRODUCT]), "lookup-scored")


def _answers(scored: DataFrame, prices: DataFrame, sold: DataFrame | None, most: int) -> DataFrame:
    """Price rows of the scored products: each gives its newest rows, those of one maker or, where makers are compared, of every maker."""
    kinds = {
        "free": F.col("only_maker").isNull() & F.col("asked_maker").isNull(),
        "made": F.col("only_maker").isNotNull(),
        "any": F.col("only_maker").isNull() & F.col("asked_maker").isNotNull(),
    }
    n = scored.agg(*[F.count_if(c).alias(kind) for kind, c in kinds.items()]).first()
    maker = F.when(F.col("asked_maker").isNull(), 0.0).when(F.col("only_maker").isNotNull(), F.col("own_score")).otherwise(trigram_similarity(trigrams(F.col("manufacturer")), F.col("maker_grams")))
    out = None
    for kind, condition in kinds.items():
        if out is not None and not n[kind]:
            continue
        own, same = scored.filter(condition), _same_product("of_")
        if kind == "made":
            rows, same = sold, same & (F.col("manufacturer") == F.col("only_maker"))
        else:
            ids = own.select("product_id").distinct()
            ids = F.broadcast(ids) if n[kind] <= BROADCAST_IDS or ids.count() <= BROADCAST_IDS else ids
            rows = prices.withColumn("product", F.xxhash64(*PRODUCT)).join(ids, F.col("product") == F.col("product_id"), "left_semi").drop("product")
            rows = _newest(rows, PRODUCT if kind == "free" else [*PRODUCT, "manufacturer"], most)
        rows = rows.drop("place").join(small_side(own, n[kind]), same).withColumn("maker_score", maker)
        out = rows if out is None else out.unionByName(rows)
    return _first(out)


def _most(plan: DataFrame) -> int:
    return max(plan.agg(F.max("k")).first()[0] or 1, 1)


def _exact(plan: DataFrame, products: DataFrame) -> DataFrame:
    every = _all_in("words", "name_tokens") & _all_in("asked_category", "category_tokens")
    return _matches(plan, products, plan.count()).filter(every).withColumns({"tier": F.lit(0), "need": F.lit(0)})


def lookup_exact(requests: DataFrame, prices: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """The k best rows that hold every word of the request, category words included. products: a stored :func:`index`."""
    products = materialize(index(prices), "lookup-index") if products is None else products
    own, members = _once(requests)
    plan = materialize(request_plan(own, products), "lookup-plan")
    makers, most = _makers(plan, prices), _most(plan)
    sold = None if makers is None else _sold(makers, prices, most)
    scored = _best(_by_maker(_exact(plan, products), makers, sold), plan, most)
    return _for_all(_answers(scored, prices, sold, most), members)


def count_exact(requests: DataFrame, prices: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """(request_id, n): how many rows :func:`lookup_exact` gives, k at most, from the counts of the products; none if there is no row."""
    products = materialize(index(prices), "lookup-index") if products is None else products
    own, members = _once(requests)
    plan = materialize(request_plan(own, products), "lookup-plan")
    found, makers = _exact(plan, products), _makers(plan, prices)
    n_rows = found.filter(F.size("maker_words") == 0).select("request_id", "n_rows")
    if makers is not None:
        names = makers.select("only_maker").distinct()
        sold = prices.join(small_side(names, names.count()), F.col("manufacturer") == F.col("only_maker"), "left_semi").groupBy(*PRODUCT, "manufacturer").agg(F.count(F.lit(1)).alias("n_rows"))
        made = found.filter(F.size("maker_words") > 0).select("request_id", "product_id", *[F.col(c).alias(f"of_{c}") for c in PRODUCT]).join(small_side(makers, makers.count()), "request_id")
        n_rows = n_rows.unionByName(sold.join(made, _same_product("of_") & (F.col("manufacturer") == F.col("only_maker"))).select("request_id", "n_rows"))
    counted = n_rows.groupBy("request_id").agg(F.sum("n_rows").alias("n")).join(plan.select("request_id", "k"), "request_id")
    return _for_all(counted.select("request_id", F.least("n", F.col("k").cast("long")).alias("n")).filter("n > 0"), members)


def _without_words(plan: DataFrame, products: DataFrame, makers: DataFrame | None, sold: DataFrame | None) -> DataFrame | None:
    """Products of requests without a usable name word: by the maker's words, by substring of the name, or both."""
    bare = materialize(_asked(plan.filter(F.size("words") == 0)), "lookup-bare")
    n = bare.count()
    if not n:
        return None
    columns = ["request_id", "product_id", *PRODUCT, "n_rows", "newest", "asked_category", "category_tokens", *_free()]
    named = F.coalesce(F.col("asked_name"), F.lit("")) != ""
    plain = bare.filter((F.size("maker_words") == 0) & named).withColumn("needle", F.lower("asked_name"))
    # names and needles repeat; each is searched once
    inside = contains_join(products.select("material_name").distinct(), F.lower("material_name"), plain.select("needle").distinct(), "needle", "needle")
    rows = products.join(inside, "material_name").join(small_side(plain, n), "needle").filter(_passes()).withColumns(_free()).select(*columns)
    if makers is not None:
        # asked products of a maker: the products of its rows
        asked = bare.join(makers, "request_id")
        within = ~named | F.contains(F.lower("material_name"), F.lower("asked_name"))
        made = _sold_products(sold).join(small_side(asked, asked.count()), F.col("seller") == F.col("only_maker")).filter(within & _passes())
        made = made.withColumns({"product_id": F.xxhash64(*PRODUCT), "category_tokens": name_tokens(F.col("material_category")), "n_rows": F.lit(None).cast("long"), "newest": F.col("newest_sold")})
        rows = rows.unionByName(made.select(*columns))
    return rows.withColumn("scored", F.lit(False))


#: Most bits that stand for the words of a query set, and bits for each word.
MAX_BITS, WORD_BITS = 1 << 16, 64


def _one_of(words: DataFrame) -> Callable[[Column], Column]:
    """A test that every value of ``words`` passes, and few others; only bits go through the driver, ``MAX_BITS`` at most."""
    n, bits = words.count(), 64
    while bits < min(WORD_BITS * n, MAX_BITS):
        bits *= 2
    places = lambda w: [F.pmod(F.xxhash64(F.lit(i), w), F.lit(bits)) for i in range(2)]
    at = words.select(F.explode(F.array(*places(F.col(words.columns[0])))).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).cast("int").alias("n")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set")).collect()
    held = [0] * (bits // 64)
    for r in rows:
        held[r.n] = r.set
    sets = F.lit(held).cast("array<bigint>")
    is_set = lambda p: F.getbit(F.get(sets, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
    return lambda w: is_set(places(w)[0]) & is_set(places(w)[1])


def _by_raw_text(plan: DataFrame, prices: DataFrame, answered: DataFrame, most: int) -> DataFrame | None:
    """The last resort of requests that no tier answered: every word of the maker, else the name, in the raw row.

    A row counts only by its region and the asked words that it holds, so of each such
    set the newest rows are found first, and requests are joined with the sets, on the
    word of theirs that the fewest sets hold: no request meets the rows, or their texts.
    """
    term = F.coalesce(F.nullif("manufacturer", F.lit("")), "material_name")
    words = F.array_sort(F.coalesce(F.array_distinct(match_words(term)), F.array().cast("array<string>")))
    left = plan.withColumn("words", words).filter(F.size("words") >= RAW_MIN_WORDS).join(answered, "request_id", "left_anti")
    left = left.select("request_id", F.col("region").alias("asked_region"), "k", "words")
    left = materialize(left.withColumn("same", _same(left, ["asked_region", "k", "words"])), "lookup-raw")
    # requests of the same words and region find the same rows
    asked = left.drop("request_id").dropDuplicates(["same"])
    n = asked.count()
    if not n:
        return None
    known = _one_of(asked.select(F.explode("words").alias("word")).distinct())
    held = F.array_sort(F.filter(name_tokens(F.col("raw_row_text")), known))
    # exploded: a filter would be put before the column, which computes the words again
    enough = F.explode(F.filter(F.array(held), lambda x: F.size(x) >= RAW_MIN_WORDS))
    rows = prices.select(*[c for c in OUT if c in prices.columns], "created_at", enough.alias("held")).withColumn("held", F.array_join("held", " "))
    rows = materialize(_newest(rows, ["held", "region"], most), "lookup-texts")
    sets = rows.filter("place = 1").select(F.col("held").alias("of_held"), "region", F.split("held", " ").alias("tokens"))
    counts = sets.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    each = asked.select("same", F.explode("words").alias("word")).join(counts, "word", "left")
    # a word that no set holds comes first, and finds nothing
    rarest = each.groupBy("same").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).filter("r.n > 0").select("same", F.col("r.word").alias("anchor"))
    asked = materialize(asked.join(rarest, "same"), "lookup-rarest")
    found = sets.withColumn("anchor", F.explode_outer("tokens")).join(small_side(asked, n), "anchor").filter(_in_region()).filter(_all_in("words", "tokens"))
    found = materialize(found.select("same", "k", "of_held", F.col("region").alias("of_region")), "lookup-sets")
    own = (F.col("held") == F.col("of_held")) & F.col("region").eqNullSafe(F.col("of_region"))
    rows = rows.drop("place").join(small_side(found, found.count()), own).withColumnRenamed("same", "request_id")
    rows = rows.withColumns({"tier": F.lit(2), "need": F.lit(0), "name_score": F.lit(None).cast("double"), "maker_score": F.lit(0.0)})
    return _for_all(_first(rows), left.select("request_id", "same"))


def lookup(requests: DataFrame, prices: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """The k best rows of the best tier: with the category, without it, then by raw row text.

    Inside a tier only rows at its first successful drop level count. A request without
    usable words matches by its maker and by substring of the name. The raw-text tier
    takes the manufacturer, else the name, needs three words, ignores unit and
    exclusions, and gives the newest rows first. Tiers that no request needs are not run.
    products: a stored :func:`index` of ``prices``; without it, one is made.
    """
    products = materialize(index(prices), "lookup-index") if products is None else products
    own, members = _once(requests)
    plan = materialize(request_plan(own, products), "lookup-plan")
    makers, most = _makers(plan, prices), _most(plan)
    sold = None if makers is None else _sold(makers, prices, most)
    found = _matches(plan, products, plan.count())
    need = F.array_max(F.concat(F.array(F.lit(0)), F.transform("ordered", lambda w, i: F.when(F.array_contains("name_tokens", w), 0).otherwise(i + 1))))
    tier = F.when((F.size("asked_category") > 0) & _all_in("asked_category", "category_tokens"), 0).otherwise(1)
    found = _by_maker(found.withColumns({"need": need, "tier": tier}), makers, sold)
    bare = _without_words(plan, products, makers, sold)
    if bare is not None:
        found = found.unionByName(bare.withColumns({"need": F.lit(0), "tier": tier}).select(*found.columns))
    scored = _best(found, plan, most)
    out = _answers(scored, prices, sold, most)
    raw = _by_raw_text(plan, prices, scored.select("request_id").distinct(), most)
    return _for_all(out if raw is None else out.unionByName(raw), members)


def lookup_substring(requests: DataFrame, prices: DataFrame, k: int = 1) -> DataFrame:
    """The older lookup: the whole name as a substring, newest first."""
    asked = requests.select("request_id", F.col("region").alias("asked_region"), F.lower("material_name").alias("asked")).filter("asked IS NOT NULL")
    # names and needles repeat; each is searched once, and a name gives its newest rows of each region only
    named = materialize(contains_join(prices.select(F.col("material_name").alias("name")).distinct(), F.lower("name"), asked.select("asked").distinct(), "asked", "asked").select("name", "asked"), "lookup-names")
    rows = _newest(prices.select("price_id", "material_name", "region", "price_period", "created_at"), ["material_name", "region"], k).drop("place")
    found = rows.join(small_side(named, named.count()), F.col("material_name") == F.col("name"))
    # the newest of each region, then of all regions
    by_region = materialize(_newest(found, ["asked", "region"], k).drop("place"), "lookup-regions")
    everywhere = _newest(by_region, ["asked"], k)
    own = _newest(by_region, ["asked", "region"], k).filter("region IS NOT NULL")
    best = own.select("asked", F.col("region").alias("asked_region"), F.col("place").alias("rank"), "price_id", "material_name")
    best = best.unionByName(everywhere.select("asked", F.lit(None).cast("string").alias("asked_region"), F.col("place").alias("rank"), "price_id", "material_name"))
    return asked.join(best, (asked.asked == best.asked) & asked.asked_region.eqNullSafe(best.asked_region)).select("request_id", "rank", "price_id", "material_name")


def eval_lookup(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(n_cases, n_right): whether the first row's name contains what was expected."""
    first = results.filter("rank = 1").select("request_id", "material_name")
    right = F.contains(F.lower("material_name"), F.lower("expect"))
    return cases.select("request_id", "expect").join(first, "request_id", "left").agg(F.count(F.lit(1)).alias("n_cases"), F.coalesce(F.sum(F.when(right, 1).otherwise(0)), F.lit(0)).alias("n_right"))


BASIS_LABELS = {"tai_mo": "tại mỏ/nơi sản xuất", "tai_chan_cong_trinh": "tại chân công trình", "khong_ro": "không rõ điều kiện giao"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def format_lookup(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(request_id, rank, line): one text line for each row, and one for a request without any."""
    price = F.format_number("price_ex_vat", 0)
    basis = F.coalesce(F.try_element_at(_map(BASIS_LABELS), F.col("price_basis")), F.col("price_basis"))
    line = F.concat_ws(" | ", "material_name", F.concat(price, F.lit(" VND/"), "unit"), basis, "price_period", "manufacturer")
    rows = requests.select("request_id").join(results, "request_id", "left")
    return rows.select("request_id", F.coalesce("rank", F.lit(0)).alias("rank"), F.when(F.col("price_id").isNull(), "not found").otherwise(line).alias("line"))


def price_quality(prices: DataFrame) -> DataFrame:
    """(n_rows, n_digit_names, n_company_categories)."""
    company = F.lower("material_category").rlike(r"công ty|cty|tnhh|cổ phần")
    return prices.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("material_name").rlike("^[0-9]")).alias("n_digit_names"), F.count_if(company).alias("n_company_categories"))


def price_spread(prices: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, n, least, most) over names that contain the phrase."""
    names = prices.groupBy("material_name").agg(F.count("price_id").alias("n"), F.min("price_ex_vat").alias("least"), F.max("price_ex_vat").alias("most"))
    found = contains_join(names, F.lower("material_name"), phrases.select(F.col("phrase").alias("found"), F.lower("phrase").alias("needle")), "needle", "found")
    spread = found.groupBy("found").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    return phrases.join(spread, F.col("phrase") == F.col("found"), "left").select("phrase", F.coalesce("n", F.lit(0)).alias("n"), "least", "most")


def region_name(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(REGION_NAMES), c), c)

