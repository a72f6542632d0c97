"""Joins that would be nested loops, split into branches with an equality each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _grams(name: str, size: int) -> Column:
    """All runs of `size` characters of a name; none of a shorter one."""
    n = F.length(name) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(F.col(name), i, F.lit(size)))))


def _candidates(short: DataFrame, long: DataFrame, least: int) -> DataFrame:
    """(state, sname, lname): the distinct short names whose runs of characters long names of the state have, each with the
    long names that have its rarest run. Runs go by their hash, which can only add candidates."""
    gram = lambda c: F.explode(F.transform(_grams(c, least), lambda g: F.xxhash64(g)))
    runs = long.select("state", F.col("name").alias("lname")).distinct().select("state", "lname", gram("lname").alias("gram"))
    counts = runs.groupBy("state", "gram").agg(F.count("*").alias("n"))
    mine = short.select("state", F.col("name").alias("sname")).distinct().select("state", "sname", gram("sname").alias("gram"))
    rare = mine.join(counts, ["state", "gram"], "left").groupBy("state", "sname").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all")).where("all")
    return rare.join(runs, ["state", "gram"]).select("state", "sname", "lname")


def containing(short: DataFrame, long: DataFrame, least: int) -> DataFrame:
    """Pairs (sid, lid) of names (sid, state, name; lid, state, name) of which the short one, of at least `least` characters,
    is contained in the long one of the same state. A contained name's runs of characters are all in the other, so a name
    with a run that no long name of the state has is in none; the others are looked up by the run that the fewest long
    names have, and then verified. A name of a state is looked up once for all rows that have it."""
    names = _candidates(short, long, least).where(F.col("lname").contains(F.col("sname")))
    found = names.join(short.select("sid", "state", F.col("name").alias("sname")), ["state", "sname"])
    return found.join(long.select("lid", "state", F.col("name").alias("lname")), ["state", "lname"]).select("sid", "lid")


def match_or_contains(left: DataFrame, right: DataFrame, lid: str, rid: str, lname: str, rname: str, lstate: str, rstate: str, least: int = 8) -> DataFrame:
    """Pairs (lid, rid) whose names are equal (in one state, or in any where the left state is null), or of which one,
    of at least `least` characters without blanks, contains the other within a state. Each branch has an equality:
    name and state, name alone for rows without a state, or state and a rare run of characters."""
    a = left.select(F.col(lid).alias("__l"), F.col(lname).alias("__ln"), F.col(lstate).alias("__ls"), F.replace(lname, F.lit(" "), F.lit("")).alias("__lc"))
    b = right.select(F.col(rid).alias("__r"), F.col(rname).alias("__rn"), F.col(rstate).alias("__rs"), F.replace(rname, F.lit(" "), F.lit("")).alias("__rc"))
    both = a.where("__ls is not null").join(b, (F.col("__ls") == F.col("__rs")) & (F.col("__ln") == F.col("__rn")))
    anywhere = a.where("__ls is null").join(b, F.col("__ln") == F.col("__rn"))
    # the left name must be long enough on either side of a containment
    named = lambda x, key, i, name, state: x.where(F.col(state).isNotNull() & (F.length(name) >= least)).select(F.col(i).alias(key), F.col(state).alias("state"), F.col(name).alias("name"))
    inside = containing(named(a, "sid", "__l", "__lc", "__ls"), named(b, "lid", "__r", "__rc", "__rs"), least).select(F.col("sid").alias("__l"), F.col("lid").alias("__r"))
    around = containing(named(b, "sid", "__r", "__rc", "__rs"), named(a, "lid", "__l", "__lc", "__ls"), least).select(F.col("lid").alias("__l"), F.col("sid").alias("__r"))
    pairs = [x.select(F.col("__l").alias(lid), F.col("__r").alias(rid)) for x in (both, anywhere, inside, around)]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).unionByName(pairs[3]).distinct()


def capped(pairs: DataFrame, key: list[str], most: int) -> DataFrame:
    """Pairs of the keys with at most `most` candidates: a key with more is ambiguous and gives none."""
    return pairs.withColumn("n_cand", F.count("*").over(Window.partitionBy(*key))).where(F.col("n_cand") <= most)


def pairs_in_blocks(df: DataFrame, unique: str, block: Column, order: list[str], most: int = 400, near: int = 5) -> DataFrame:
    """(a, b), a before b, of rows in one block: all pairs in blocks of up to `most` rows; in larger ones each row with
    the `near` that follow it in the order. So pairs grow in proportion to the rows. Rows without a block have none."""
    x = df.withColumn("__block", block).where("__block is not null")
    x = x.withColumn("__i", F.row_number().over(Window.partitionBy("__block").orderBy(*order, unique))).withColumn("__n", F.count("*").over(Window.partitionBy("__block")))
    x = x.select(F.col(unique).alias("__u"), "__block", "__i", "__n")
    small, large = x.where(F.col("__n") <= most), x.where(F.col("__n") > most)
    a, b = small.alias("a"), small.alias("b")
    pairs = a.join(b, (F.col("a.__block") == F.col("b.__block")) & (F.col("a.__i") < F.col("b.__i"))).select(F.col("a.__u").alias("a"), F.col("b.__u").alias("b"))
    # the steps to the next rows are spelt out, so the join is by equality of block and position
    ahead = large.withColumn("__j", F.explode(F.sequence(F.col("__i") + 1, F.least(F.col("__i") + near, F.col("__n"))))).where("__j > __i")
    c = large.select(F.col("__block").alias("__cb"), F.col("__i").alias("__ci"), F.col("__u").alias("b"))
    far = ahead.join(c, (F.col("__block") == F.col("__cb")) & (F.col("__j") == F.col("__ci"))).select(F.col("__u").alias("a"), "b")
    return pairs.unionByName(far).distinct()


def first_of_two_keys(left: DataFrame, lookup: DataFrame, strong: list[str], weak: list[str], value: str) -> DataFrame:
    """left with value and its level: by the strong key, else by the weak one. lookup may repeat keys: the smallest
    value of a key counts."""
    s = lookup.groupBy(*strong).agg(F.min(value).alias("__s"))
    w = lookup.groupBy(*weak).agg(F.min(value).alias("__w"))
    x = left.join(s, strong, "left").join(w, weak, "left")
    return x.withColumn(value, F.coalesce("__s", "__w")).withColumn("level", F.when(F.col("__s").isNotNull(), "high").when(F.col("__w").isNotNull(), "medium")).drop("__s", "__w")
