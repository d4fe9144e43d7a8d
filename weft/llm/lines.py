"""Near-duplicate lines across all documents, with DataFrame functions alone.

Two lines are near when they are equal or, for lines of `fuzzy_chars` characters and more, when one edit of a character
makes one the other. A line goes when any earlier line (by document id, then by place) is near to it.

Candidates first. One edit leaves a half of a line as it is: of two near lines, the longer one of M characters, either
the first or the last ceil((M - 1) / 2) characters are common. Distinct lines are put under a key for each such half;
lines alone under all their keys are done. The rest beside a shared half is halved again in the same way while it is
long, so that the work goes with the length of a line and not with its square. Then the deletion neighbourhood: each
line that is left emits, for each shared part, the hashed rest of it as it is and with each character deleted. Equal variants with the same place deleted
differ in that character at most; a rest as it is equals a variant of a line that is one character longer. Among such
lines all but the earliest go, so that a group is reduced to its least line and no list of pairs is made. The edit
distance is then verified on the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, named, table, with_nulls, written

#: Shorter lines go only with an equal earlier one: one edit is too much of them.
FUZZY_CHARS = 20
#: Characters of a rest that variants are made of; a longer one is halved again.
REST_CHARS = 256


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text, t): t tells apart the texts of rows that have one id."""
    docs = with_nulls(docs, text_column)
    rows = docs.select(named(id_column).cast("long").alias("id"), named(text_column).alias("text"))
    return rows.withColumn("t", F.xxhash64("text"))


def _halves(n: str, line: str) -> list:
    """Of a line of n characters, as one of two whose longer has M = n or n + 1: its first and last half under a key,
    and the rest. longer: M = n, so that the edit may have been a character of this line."""
    out = []
    for m, longer in ((n, "true"), (f"({n} + 1)", "false")):
        half = f"cast({m} div 2 as int)"  # ceil((M - 1) / 2)
        kept = (f"substring({line}, 1, {half})", f"substring({line}, {n} - {half} + 1)")
        rest = (f"substring({line}, {half} + 1)", f"substring({line}, 1, {n} - {half})")
        for side in (0, 1):
            out.append(f"named_struct('key', xxhash64({m}, {side}, {kept[side]}), 'rest', {rest[side]}, 'longer', {longer})")
    return out


def _one_edit(a: str, b: str) -> str:
    """Whether one edit at most makes a of b. Spark's levenshtein() takes time that goes with the square of the length,
    bound or not; so for long lines the end of the common beginning is searched by halves, and what follows compared."""
    mid = "cast((s.lo + s.hi + 1) div 2 as int)"
    step = f"if(s.lo >= s.hi, s, if(left({a}, {mid}) = left({b}, {mid}), struct({mid} as lo, s.hi as hi), struct(s.lo as lo, {mid} - 1 as hi)))"
    start = f"struct(0 as lo, least(length({a}), length({b})) as hi)"
    common = f"aggregate(sequence(0, cast(log2(length({a}) + 1) as int) + 1), {start}, (s, i) -> {step}, s -> s.lo)"
    rest = f"substring({a}, {common} + 1 + int(length({a}) >= length({b}))) = substring({b}, {common} + 1 + int(length({b}) >= length({a})))"
    return f"if(length({a}) <= {REST_CHARS}, levenshtein({a}, {b}, 1) between 0 and 1, abs(length({a}) - length({b})) <= 1 and {rest})"


def _narrowed(part: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """part (first, key, rest, longer), where rests over REST_CHARS are halved, under keys of more of the line, until
    they are short; and the tables that were written for it. Each time only rests under a key that another line has too
    go on."""
    made = []
    # by the length of the longer of two lines, so that both are halved as often
    done, long = [], f"length(rest) + int(not longer) > {REST_CHARS}"
    while True:
        part = written(part, "rests")
        made.append(part)
        done.append(part.where(f"not {long}"))
        part = part.where(long)
        if part.isEmpty():
            break
        # of the longer of two lines the rest has M characters; half of it is common on one side
        part = part.withColumn("n", F.length("rest")).withColumn("half", F.expr("cast(if(longer, n, n + 1) div 2 as int)"))
        sides = "named_struct('key', xxhash64(key, 0, substring(rest, 1, half)), 'rest', substring(rest, half + 1)), named_struct('key', xxhash64(key, 1, substring(rest, n - half + 1)), 'rest', substring(rest, 1, n - half))"
        part = part.select("first", F.explode(F.expr(f"array({sides})")).alias("x"), "longer").select("first", "x.key", "x.rest", "longer")
        shared = part.groupBy("key").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low <> high").select("key")
        part = part.join(shared, "key", "left_semi").select("first", "key", "rest", "longer")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, made


def dropped_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """(id, t, pos): the lines that an earlier line is near to; t is xxhash64 of the row's text, pos counts all lines of
    the text from 0. Earlier: by id, then pos, then t. Blank lines never go. Rows without an id take no part. Rows
    equal in id and text are one. An empty table, null and empty texts have no lines that go."""
    rows = _rows(docs, id_column, text_column)
    lines = rows.where("id is not null").select("id", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(r"line rlike '\\S'")
    halves = _halves("length(line)", "line")
    keys = f"case when length(line) >= {fuzzy_chars} then array({', '.join(f'{h}.key' for h in halves)}) end"
    seen = lines.select(F.struct("id", "pos", "t").alias("at"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.expr(keys).alias("keys"))
    seen = written(seen, "lines")

    # distinct lines, each with the place of the first one
    keys = [F.first(F.col("keys")[k]).alias(f"k{k}") for k in range(4)]
    distinct = written(seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("at").alias("first"), *keys), "distinct-lines")
    repeats = distinct.where("n > 1").select("h1", "h2", "first")

    # those that share a half with another, and those halves
    under = distinct.where("k0 is not null").select("h1", "h2", "first", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))
    shared = written(under.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key"), "shared-halves")
    left = under.join(shared, "key")
    left = left.groupBy("h1", "h2", "first").agg(F.collect_set("key").alias("shared"))  # four keys at most
    left = left.select("h1", "h2", "first", "shared", F.col("first.id").alias("lid"), F.col("first.t").alias("lt"))
    line = F.expr("split(text, '\\n')[first.pos]")
    texts = rows.join(left, (F.col("id") == F.col("lid")) & (F.col("t") == F.col("lt"))).select("h1", "h2", "first", "shared", line.alias("line"))
    texts = written(texts.dropDuplicates(["first"]), "line-texts")

    # the deletion neighbourhood of the rest beside each shared half; place 0 is the rest as it is
    part = texts.select("first", "shared", F.explode(F.expr(f"array({', '.join(halves)})")).alias("half"))
    part, rests = _narrowed(part.where("array_contains(shared, half.key)").select("first", "half.key", "half.rest", "half.longer"))
    variants = "transform(sequence(1, length(rest)), i -> struct(i as place, xxhash64(key, concat(substring(rest, 1, i - 1), substring(rest, i + 1))) as v))"
    variant = F.explode(F.expr(f"if(longer, {variants}, array(struct(0 as place, xxhash64(key, rest) as v)))"))
    emitted = part.select("first", variant.alias("x")).select("first", "x.*")
    # a variant has at most one whole rest, and for each place at most as many lines as there are characters
    equal = emitted.groupBy("v").agg(F.collect_set(F.struct("place", "first")).alias("all")).where("size(all) > 1")
    equal = written(equal.select("v", F.explode("all").alias("x")).select("v", "x.*"), "variants")

    # of lines with one place deleted, the least stands for the others; a whole rest meets each line one longer
    least = equal.where("place > 0").groupBy("v", "place").agg(F.min("first").alias("m"), F.count("*").alias("n")).where("n > 1")
    same = equal.join(least, ["v", "place"]).select("first", F.col("m").alias("other"))
    rest = equal.where("place = 0").select("v", F.col("first").alias("m"))
    longer = equal.where("place > 0").join(rest, "v").select("first", F.col("m").alias("other"))
    pairs = same.unionByName(longer).where("first <> other")
    pairs = pairs.select(F.greatest("first", "other").alias("first"), F.least("first", "other").alias("other")).distinct()
    later = texts.select("h1", "h2", "first", F.col("line").alias("line"))
    earlier = texts.select(F.col("first").alias("other"), F.col("line").alias("model"))
    near = pairs.join(later, "first").join(earlier, "other").where(_one_edit("line", "model"))
    near = near.select("h1", "h2", F.col("other").alias("first"))

    # written, so that the join is not bound to the aggregate's partitions and a very common line can be split
    goes = written(repeats.unionByName(near).groupBy("h1", "h2").agg(F.min("first").alias("least")), "line-drops")
    for over in (distinct, shared, texts, equal, *rests):
        forget(over)
    return seen.join(goes, ["h1", "h2"]).where("at > least").select("at.id", "at.t", "at.pos").distinct()


def _by_row(dropped: DataFrame) -> DataFrame:
    return dropped.groupBy("id", "t").agg(F.sort_array(F.collect_list("pos")).alias("gone")).select(F.col("id").alias("gone_id"), F.col("t").alias("gone_t"), "gone")


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """docs, the texts without the lines that go (see dropped_lines); n_chars, where there is such a column, follows.
    All rows stay, with an empty text where every line went."""
    docs = with_nulls(docs, text_column)
    gone = _by_row(dropped_lines(docs, id_column, text_column, fuzzy_chars))
    names = docs.columns
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])  # no name gets in the way
    own, text = F.col(f"c{names.index(id_column)}"), F.col(f"c{names.index(text_column)}")
    joined = docs.join(gone, (own.cast("long") == gone["gone_id"]) & (F.xxhash64(text) == gone["gone_t"]), "left")
    places = gone["gone"]
    parts = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), places)
    left = F.when(places.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    out = [left.alias(c) if c == text_column else docs[f"c{k}"].alias(c) for k, c in enumerate(names)]
    if "n_chars" in names and text_column != "n_chars":
        at = names.index("n_chars")
        out[at] = F.when(places.isNull(), docs[f"c{at}"]).otherwise(F.length(left).cast(docs.schema[at].dataType)).alias("n_chars")
    return joined.select(*out)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, its lines that are not blank, how many of them go, and the places of those. Null
    and empty texts have none; in rows without an id nothing goes; rows equal in id and text are one and go together;
    no rows give no rows. Other columns play no part."""
    docs = table(spark, sf_dir, "documents")
    rows = _rows(docs, "doc_id", "text").select("id", "t", F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))), F.lit(0)).cast("long").alias("n_lines"))
    gone = _by_row(dropped_lines(docs))
    joined = rows.join(gone, (rows["id"] == gone["gone_id"]) & (rows["t"] == gone["gone_t"]), "left")
    n = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return joined.select(F.col("id").alias("doc_id"), "n_lines", n.alias("n_dropped"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("dropped"))


#: One edit leaves the characters before it and after it: lines of one length differ at a place, else the longer one
#: has a character more there. Pairs meet on a common half, as any two near lines do.
SQL = f"""
with rows as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents
), lines as (
  select doc_id, pos, line from rows where regexp_matches(line, '[^ \t\n\v\f\r]')
), firsts as (
  select line, min(row(doc_id, pos)) as first, length(line) as n from lines group by line
), halves as (
  select line, first, n, m, side, case side when 0 then left(line, m // 2) else right(line, m // 2) end as half
  from (select *, unnest([n, n + 1]) as m from firsts where n >= {FUZZY_CHARS}) cross join (values (0), (1)) s(side)
), pairs as (
  select distinct a.line as line, b.line as other, b.first as first
  from halves a join halves b on a.m = b.m and a.side = b.side and a.half = b.half and a.line <> b.line and b.first < a.first
), near as (
  select line, first from pairs where abs(length(line) - length(other)) <= 1 and len(list_filter(range(greatest(length(line), length(other))), lambda i:
    left(line, i::int) = left(other, i::int) and
    substr(line, i + 2 - (length(line) < length(other))::int) = substr(other, i + 2 - (length(other) < length(line))::int))) > 0
), least as (
  select line, min(first) as first from (select line, first from firsts union all select line, first from near) group by line
), gone as (
  select l.doc_id, l.pos from lines l join least e using (line) where row(l.doc_id, l.pos) > e.first
)
select d.doc_id, count(l.pos)::bigint as n_lines, count(g.pos)::bigint as n_dropped,
  coalesce(string_agg(g.pos::varchar, ',' order by g.pos), '') as dropped
from documents d left join lines l on d.doc_id = l.doc_id left join gone g on l.doc_id = g.doc_id and l.pos = g.pos
group by d.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with what is left of their texts (see dedup_lines()); all rows and columns stay, whatever they are called."""
    return dedup_lines(docs)
