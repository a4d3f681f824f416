"""Keys, vocabularies and references of a table, as sets.

A table's rows are accepted one by one in row order: a row is rejected by the
first that applies of a value that is not of its type or vocabulary, a key that
an accepted row holds already, a null where none may be, a reference to no
accepted row, and a null key. The plan below finds the same without order: only
rows with nothing else wrong can hold a key, and of these the least row number
does. Rejected rows are no targets, so their children are rejected too.

References within the table itself make both rules depend on each other: a row
holds its key if none before it does, and it is accepted if an earlier row holds
its parent's key. Which row first holds a key that others refer to is settled in
rounds over the rows still open (see first_holders).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.suggest import nearest
from ..plans.lineage import cut
from .checks import ROW, VIOLATION, _params
from .vocabulary import nearest_words, sized, words_table


FEW = 500  # words of a vocabulary that plans hold
PIECE = 65_536  # row numbers of a key that one group holds


@dataclass(frozen=True)
class Vocabulary:
    column: str
    target: str
    values: tuple[str, ...]
    name: str = ""
    severity: str = "warning"
    table: DataFrame | None = None  # (word, ordinal), in place of values

    @property
    def large(self) -> bool:
        """Whether its words are a table that rows are joined with; few words are part of the plan."""
        return self.table is not None or len(self.values) > FEW


@dataclass(frozen=True)
class Reference:
    """column's values must be among those of key in the accepted rows of a table, or of this one (target_table None)."""

    column: str
    target: str
    target_dataset: str
    target_field: str
    severity: str = "error"


@dataclass(frozen=True)
class Rules:
    dataset: str
    key: tuple[str, str] | None = None  # column, target
    not_null: tuple[tuple[str, str], ...] = ()
    vocabularies: tuple[Vocabulary, ...] = ()
    types: tuple[tuple[str, str], ...] = ()  # column, integer, date, double or boolean
    references: tuple[Reference, ...] = ()
    parents: dict[str, DataFrame] = field(default_factory=dict)  # dataset to its accepted rows, columns named by target
    kind: str = "kind"  # the names of the columns that tell a row's verdict; others where a table has such columns
    at: str = "at"


def _text(df: DataFrame, name: str) -> Column:
    return tx.as_text(F.col(f"`{name}`"), dict(df.dtypes)[name])


def _of_type(text: Column, kind: str) -> Column:
    match kind:
        case "integer":
            return tx.to_integer(text).isNotNull()
        case "double":
            return tx.to_double(text).isNotNull()
        case "date":
            return F.try_to_date(F.trim(text), "y-M-d").isNotNull()
        case "boolean":
            return F.lower(F.trim(text)).isin("true", "false", "t", "f", "1", "0", "yes", "no")
    return F.lit(True)


def _comparable(df: DataFrame, column: str, parents: DataFrame, key: str) -> tuple[Column, Column]:
    """Both columns as they are where their types are equal, else their texts."""
    if dict(df.dtypes)[column] == dict(parents.dtypes)[key]:
        return F.col(f"`{column}`"), F.col(f"`{key}`")
    return _text(df, column), _text(parents, key)


def orphans(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """The rows of df whose non-null column is no key of parents. An anti-join needs no distinct keys, and without them Spark can split a key that many rows refer to."""
    own, other = _comparable(df, column, parents, key)
    keys = parents.select(other.alias("_parent_key")).filter("_parent_key is not null")
    return df.filter(F.col(f"`{column}`").isNotNull()).join(keys, own == F.col("_parent_key"), "left_anti")


def duplicate_keys(df: DataFrame, column: str) -> DataFrame:
    """All rows of a repeated non-null key, with duplicate_count."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("duplicate_count")).filter("duplicate_count > 1")
    return df.join(cut(counted), column)


def words_of(spark: SparkSession, v: Vocabulary) -> DataFrame:
    return v.table if v.table is not None else words_table(spark, v.values)


def judge(df: DataFrame, rules: Rules, row: str = ROW) -> DataFrame:
    """df with kind (ok, type, enum, pk, null, fk, key_null) and at (number of the vocabulary, not-null column or reference at fault)."""
    first = lambda flags: F.coalesce(*[F.when(f, F.lit(k)) for k, f in enumerate(flags)]) if flags else F.lit(None).cast("int")
    out, enums = df, []
    for k, v in enumerate(rules.vocabularies):
        text = _text(df, v.column)
        if v.large:
            words = sized(words_of(df.sparkSession, v)).select(F.col("word").alias(f"_word{k}"))
            out = out.join(words, text == F.col(f"_word{k}"), "left")
        enums.append(text.isNotNull() & (F.col(f"_word{k}").isNull() if v.large else ~text.isin(*v.values)))
    types = [_text(df, c).isNotNull() & ~_of_type(_text(df, c), kind) for c, kind in rules.types]
    nulls = [F.col(f"`{c}`").isNull() for c, _ in rules.not_null]
    out = out.withColumns({"_enum": first(enums), "_type": first(types), "_null": first(nulls), "_key": _text(df, rules.key[0]) if rules.key else F.lit(None).cast("string")})
    misses, own_keys = [], []
    for k, r in enumerate(rules.references):
        if r.target_dataset == rules.dataset:
            own_keys += [(k, r)] if rules.key else []
            continue
        own, other = _comparable(df, r.column, rules.parents[r.target_dataset], r.target_field)
        parents = rules.parents[r.target_dataset].select(other.alias(f"_to{k}")).filter(F.col(f"_to{k}").isNotNull()).distinct().withColumn(f"_hit{k}", F.lit(True))
        out = out.join(cut(parents), own == F.col(f"_to{k}"), "left")
        misses.append((k, F.col(f"`{r.column}`").isNotNull() & F.col(f"_hit{k}").isNull()))
    key_null = F.col("_key").isNull() if rules.key else F.lit(False)
    if own_keys:
        parents = {f"_p{k}": _text(df, r.column) for k, r in own_keys}
        clean = F.col("_enum").isNull() & F.col("_type").isNull() & F.col("_null").isNull() & ~key_null
        for _, m in misses:
            clean = clean & ~m
        slim = cut(out.select(F.col(row).alias("_n"), F.col("_key").alias("_k"), clean.alias("_clean"), *[p.alias(c) for c, p in parents.items()]))
        asked = slim.select(F.explode(F.array_compact(F.array(*parents))).alias("_asked")).distinct()
        first = first_holders(slim.filter("_clean").drop("_clean"), asked, list(parents))
        for k, r in own_keys:
            held = first.select(F.col("_k").alias(f"_to{k}"), F.col("_first").alias(f"_hit{k}"))
            out = out.join(held, parents[f"_p{k}"] == F.col(f"_to{k}"), "left")
            misses.append((k, F.col(f"`{r.column}`").isNotNull() & ~F.coalesce(F.col(f"_hit{k}") < F.col(row), F.lit(False))))
    fk = F.coalesce(*[F.when(m, F.lit(k)) for k, m in sorted(misses, key=lambda x: x[0])]) if misses else F.lit(None).cast("int")
    out = out.withColumn("_fk", fk)
    clean = F.col("_enum").isNull() & F.col("_type").isNull() & F.col("_null").isNull() & F.col("_fk").isNull() & ~key_null
    if rules.key:
        # Only repeated keys can be taken: a small table, written so that the join with it is one that Spark can broadcast or split.
        repeated = out.filter("_key is not null").groupBy(F.col("_key").alias("_taken")).agg(F.min(F.when(clean, F.col(row))).alias("_winner"), F.count(F.lit(1)).alias("_times"))
        out = out.join(cut(repeated.filter("_times > 1").drop("_times")), F.col("_key") == F.col("_taken"), "left")
        taken = F.coalesce(F.col(row) > F.col("_winner"), F.lit(False))
    else:
        taken = F.lit(False)
    kind = F.when(F.col("_enum").isNotNull(), "enum").when(F.col("_type").isNotNull(), "type").when(taken, "pk").when(F.col("_null").isNotNull(), "null").when(F.col("_fk").isNotNull(), "fk").when(key_null, "key_null").otherwise("ok")
    at = F.when(F.col("_enum").isNotNull(), F.col("_enum")).when(F.col("_type").isNotNull() | taken, F.lit(None).cast("int")).when(F.col("_null").isNotNull(), F.col("_null")).otherwise(F.col("_fk"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], kind.alias(rules.kind), at.alias(rules.at))


def _followed(links: DataFrame) -> DataFrame:
    """links (_n, _k, _good, _to) with pointers followed until they come to a row whose verdict is known, which is taken over, or to one that has no pointer."""
    state = links.withColumn("_moves", F.col("_good").isNull() & F.col("_to").isNotNull())
    while not state.filter("_moves").isEmpty():
        up = state.select(F.col("_n").alias("_at"), F.col("_good").alias("_found"), F.col("_to").alias("_next"))
        on = state.filter("_moves").join(up, F.col("_to") == F.col("_at"))
        on = on.select("_n", "_k", F.col("_found").alias("_good"), F.coalesce("_next", "_to").alias("_to"), (F.col("_found").isNull() & F.col("_next").isNotNull()).alias("_moves"))
        state = cut(state.filter("not _moves").unionByName(on))
    return state.select("_n", "_k", "_good")


def _before(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (_n, _p) with what rows (_n, _k, _good) of key _p stand before row _n: _least and _latest (the first and last one's _n), _some (whether one is good).

    Both are read once in their order, a key in pieces of ``PIECE`` row numbers, so that one key's rows needn't be one group.
    """
    none = F.lit(None)
    own = rows.select(F.col("_k").alias("_p"), "_n", F.lit(1).alias("_row"), F.col("_n").alias("_m"), F.coalesce("_good", F.lit(False)).alias("_is"))
    both = own.unionByName(asks.select("_p", "_n", F.lit(0).alias("_row"), none.cast(dict(rows.dtypes)["_n"]).alias("_m"), none.cast("boolean").alias("_is")))
    both = both.withColumn("_piece", F.floor(F.col("_n") / PIECE))
    told = lambda at, least, latest, some: [F.min(least).over(at).alias("_least"), F.max(latest).over(at).alias("_latest"), F.max(some).over(at).alias("_some")]
    pieces = both.groupBy("_p", "_piece").agg(F.min("_m").alias("_low"), F.max("_m").alias("_high"), F.max("_is").alias("_any"))
    earlier = Window.partitionBy("_p").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_p", "_piece", *[c.alias(f"{x}_before") for c, x in zip(told(earlier, "_low", "_high", "_any"), ("_least", "_latest", "_some"))])
    inside = Window.partitionBy("_p", "_piece").orderBy("_n", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.select("_p", "_piece", "_n", "_row", *told(inside, "_m", "_m", "_is")).filter("_row = 0").join(cut(pieces), ["_p", "_piece"])
    return seen.select("_n", "_p", F.least("_least", "_least_before").alias("_least"), F.coalesce("_latest", "_latest_before").alias("_latest"), (F.coalesce("_some", F.lit(False)) | F.coalesce("_some_before", F.lit(False))).alias("_some"))


def first_holders(rows: DataFrame, asked: DataFrame, parents: Sequence[str]) -> DataFrame:
    """(_k, _first): for each key that is asked for the first row that holds it, if any does.

    rows: those that may hold their key, with _n (row number), _k and parents,
    columns of keys that earlier rows must hold; asked: all keys that any row
    refers to. A row holds its key once all its parents are held by earlier
    rows; later rows of the key no longer matter. In each round an open row
    learns that a parent is held before it, or that no open row before it could
    hold it. If it waits for one parent alone, and the open rows of that all
    wait for one key too, the latest of them before it has its verdict: what
    holds that key before an earlier one does so before the latest. So has the
    one row that could hold the parent where no other could. Such pointers are
    doubled, so hierarchies of any depth and any number of rows a key take one
    round while a key's rows have the same parent. A further round is needed
    for each level of keys whose rows wait for several. The least open row is
    settled in each, so rounds end.
    """
    inner = cut(rows.join(asked, F.col("_k") == F.col("_asked"), "left_semi"))
    root = F.lit(True)
    for p in parents:
        root = root & F.col(p).isNull()
    first = cut(inner.filter(root).groupBy("_k").agg(F.min("_n").alias("_first")))
    left = lambda rows: cut(rows.join(first, "_k", "left").filter("_first is null or _n < _first").drop("_first"))
    still = left(inner.filter(~root))
    while not still.isEmpty():
        keys = still.groupBy("_k").agg(F.min("_n").alias("_least")).join(first, "_k", "full_outer").withColumnRenamed("_k", "_p")
        asks = still.select("_n", "_k", F.explode(F.array_distinct(F.array_compact(F.array(*parents)))).alias("_p")).join(keys, "_p", "left")
        held, lost = F.coalesce(F.col("_first") < F.col("_n"), F.lit(False)), F.coalesce(F.col("_least") >= F.col("_n"), F.col("_least").isNull())
        told = asks.groupBy("_n", "_k").agg(F.bool_or(~held & lost).alias("_lost"), F.count_if(~held & ~lost).alias("_waits"), F.max(F.when(~held & ~lost, F.col("_p"))).alias("_p"))
        told = cut(told.select("_n", "_k", "_waits", "_p", F.when(F.col("_lost"), False).when(F.col("_waits") == 0, True).alias("_good")))
        could = told.filter("_good is null or _good")
        waits = told.filter("_good is null and _waits = 1")
        found = cut(_before(could, waits))
        alike = could.filter("_good is null").groupBy(F.col("_k").alias("_p")).agg(((F.max("_waits") == 1) & (F.min("_p") == F.max("_p"))).alias("_alike"))
        to = F.when(F.col("_alike") | (F.col("_least") == F.col("_latest")), F.col("_latest"))
        good = F.when(F.col("_some"), True).when(F.col("_latest").isNull(), False)
        now = waits.select("_n", "_k").join(found, "_n").join(alike, "_p", "left").select("_n", "_k", good.alias("_good"), F.when(good.isNull(), to).alias("_to"))
        rest = told.filter("_good is not null or _waits > 1").select("_n", "_k", "_good", F.lit(None).cast(dict(told.dtypes)["_n"]).alias("_to"))
        done = _followed(cut(now.unionByName(rest)))
        first = cut(first.unionByName(done.filter("_good").groupBy("_k").agg(F.min("_n").alias("_first"))).groupBy("_k").agg(F.min("_first").alias("_first")))
        still = left(still.join(done.filter("_good is null").select("_n"), "_n", "left_semi"))
    return first


def integrity_violations(judged: DataFrame, rules: Rules, row: str = ROW, suggest: bool = True) -> DataFrame:
    """One violation per rejected row (none for a wrong type), and for each key that was taken all rows of that key.

    However many rules there are, rejected rows are read in one pass, and told by the rule that rejected them; taken keys take another.
    """
    number = F.col(row).cast("bigint").alias("row_number")
    told = []

    def violation(tag: str, severity: str, column: str, target: str, value: Column, message: Column, params: dict[str, Column]) -> Column:
        return F.struct(F.lit(tag).alias("tag"), F.lit(severity).alias("severity"), F.lit(column).alias("field_name"), F.lit(target).alias("target_name"), number, F.coalesce(value, F.lit("")).alias("value"), message.alias("error_message"), _params(params).alias("params"))

    def add(kind: str, at: int | None, *parts) -> None:
        fault = F.col(rules.kind) == kind
        told.append(F.when(fault if at is None else fault & (F.col(rules.at) == at), violation(*parts)))

    parts = []
    for k, v in enumerate(rules.vocabularies):
        text = _text(judged, v.column)
        if v.large:
            parts.append(_unknown_words(judged, (F.col(rules.kind) == "enum") & (F.col(rules.at) == k), v, text, violation, suggest))
            continue
        near = nearest(text, v.values) if suggest else F.lit(None).cast("string")
        message = F.concat(F.lit('Invalid value "'), text, F.lit('".'), F.coalesce(F.concat(F.lit(' Did you mean "'), near, F.lit('"?')), F.lit("")))
        add("enum", k, "EnumViolation", v.severity, v.column, v.target, text, message, {"enumType": F.lit(v.name or v.target), "allowedValues": F.lit(", ".join(v.values)), "suggestedValue": near})
    repeated = None
    if rules.key:
        column, target = rules.key
        taken = judged.filter(F.col(rules.kind) == "pk").select(F.col(f"`{column}`").alias("_taken")).distinct()
        counted = judged.groupBy(F.col(f"`{column}`").alias("_taken")).agg(F.count(F.lit(1)).alias("_n"))
        rows = judged.join(cut(counted.join(taken, "_taken")), F.col(f"`{column}`") == F.col("_taken"))
        text = _text(judged, column)
        message = F.concat(F.lit('Duplicate primary key: "'), text, F.lit('"'))
        repeated = rows.select(violation("PrimaryKeyViolation", "error", column, target, text, message, {"constraintType": F.lit("primary-key"), "duplicateCount": F.col("_n").cast("string")}).alias("_told"))
        add("key_null", None, "NotNullViolation", "error", column, target, F.lit(""), F.lit(f'Required field "{column}" cannot be NULL'), {})
    for k, (column, target) in enumerate(rules.not_null):
        add("null", k, "NotNullViolation", "error", column, target, F.lit(""), F.lit(f'Required field "{column}" cannot be NULL'), {})
    for k, r in enumerate(rules.references):
        text = _text(judged, r.column)
        message = F.concat(F.lit(f"Foreign key violation in '{rules.dataset}': {r.column} value \""), text, F.lit(f'" does not exist in {r.target_dataset}.{r.target_field}'))
        add("fk", k, "ForeignKeyViolation", r.severity, r.column, r.target, text, message, {"targetDataset": F.lit(r.target_dataset), "targetField": F.lit(r.target_field)})
    if told:
        own = F.coalesce(*told)
        parts.append(judged.filter(F.col(rules.kind).isin("enum", "null", "fk", "key_null")).select(own.alias("_told")).filter("_told is not null"))
    if repeated is not None:
        parts.append(repeated)
    if not parts:
        return judged.sparkSession.createDataFrame([], VIOLATION)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.select("_told.*")


def _unknown_words(judged: DataFrame, wrong: Column, v: Vocabulary, text: Column, violation, suggest: bool) -> DataFrame:
    """The violations of a large vocabulary: nearest words are looked up once for each different value."""
    bad = judged.filter(wrong).withColumn("value", text)
    words = words_of(judged.sparkSession, v)
    if suggest:
        bad = bad.join(cut(nearest_words(bad, words)), "value", "left")
    else:
        bad = bad.withColumn("nearest", F.lit(None).cast("string"))
    message = F.concat(F.lit('Invalid value "'), F.col("value"), F.lit('".'), F.coalesce(F.concat(F.lit(' Did you mean "'), F.col("nearest"), F.lit('"?')), F.lit("")))
    params = {"enumType": F.lit(v.name or v.target), "allowedValues": F.lit(f"{words.count()} words"), "suggestedValue": F.col("nearest")}
    return bad.select(violation("EnumViolation", v.severity, v.column, v.target, F.col("value"), message, params).alias("_told"))


def used_columns(rules: Rules, row: str = ROW) -> list[str]:
    """The columns of a judged table that integrity_violations reads."""
    named = [rules.key[0]] if rules.key else []
    named += [v.column for v in rules.vocabularies] + [c for c, _ in rules.not_null] + [r.column for r in rules.references]
    return list(dict.fromkeys([row, *named, rules.kind, rules.at]))


def accepted(judged: DataFrame, columns: Sequence[tuple[str, str]], kind: str = "kind") -> DataFrame:
    """The accepted rows, columns renamed to their targets."""
    return judged.filter(F.col(kind) == "ok").select(*[F.col(f"`{c}`").alias(t) for c, t in columns])
