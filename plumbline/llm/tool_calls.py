"""Chat formatting: tool calls joined to their results, put in order, validated, and written as canonical JSON.

Calls and results meet in an equality join on the call's identifier. Results are brought to one row per
identifier before it, so an identifier that very many rows share multiplies nothing.

Order: a call comes after all calls it refers to. Each call gets the pair (major, minor), which rises along
every reference: major is the latest position among the call and all it depends on, minor the number of
steps since the call at that position. Where all references point back, that is (position, 0) without any
work; only calls after a forward reference are peeled, level by level. What can't be peeled is on a
cycle or after one and has no order. Conversations are never gathered; their calls are rows.

Schemas are compiled into one projection; arguments are parsed once, into a variant, whose objects have
sorted keys, and every number is written in one form, so equal arguments give equal JSON.

The search for an order runs jobs when the frame is built, two for each level of calls after a forward reference. A round
writes only the calls it adds.

Nulls: a null identifier links to nothing and is referred to by nothing; a null position counts as 0;
null arguments, or such as aren't a JSON object, fail the validation. Several results of a call: the
earliest, then the smallest, is linked, and all are counted. Calls that share an identifier are all kept,
with the first position of these for references; repeated rows are calls like others, and texts are taken whole, however long. References to unknown calls are reported and otherwise ignored. Empty
tables give empty tables. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import stage

#: Names that a schema's types have in a parsed variant.
NUMBERS = ["BIGINT", "DOUBLE", "DECIMAL"]
KINDS = {"string": ["STRING"], "integer": NUMBERS, "number": NUMBERS, "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}
#: Rounds of the search for an order after which its results so far are written as one table.
ROUNDS = 8
# The pieces of a JSON text: strings, numbers, and what stands between.
PIECES = r'"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+\-]*|[^"0-9\-]+'


def canonical(json: Column) -> Column:
    """A JSON text with every number in one form: whole ones as digits, others as the shortest double."""

    def one(piece: Column) -> Column:
        number = piece.try_cast("double")
        whole = (number == F.rint(number)) & (F.abs(number) < 1e37)
        written = F.when(whole, number.try_cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))
        digits = F.regexp_replace(piece, "^-0+$", "0")
        return F.when(~piece.rlike("^-?[0-9]"), piece).when(piece.rlike("[.eE]"), F.coalesce(written, piece)).otherwise(digits)

    return F.array_join(F.transform(F.regexp_extract_all(json, F.lit(PIECES), F.lit(0)), one), "")


def errors(arguments: Column, name: Column, schemas: dict) -> Column:
    """What is wrong with the variant ``arguments`` under the schema of the tool ``name``, as strings.

    ``schemas``: tool -> {"properties": {parameter: {"type", "minLength", "maxLength", "minimum",
    "maximum", "enum"}}, "required": [...]}, the usual keywords of JSON Schema. A number without a fraction is an integer
    however it is written, and a value is in an enumeration if one of its members is equal and of the same type.
    """
    found: list[Column] = [F.when(name.isNull() | ~name.isin(list(schemas)), F.lit("unknown tool"))]
    whole = F.regexp_extract(F.schema_of_variant(arguments), "^[A-Z]+", 0)
    found.append(F.when(arguments.isNull() | (whole != "OBJECT"), F.lit("arguments: not an object")))
    for tool, schema in sorted(schemas.items()):
        for parameter, rules in sorted(schema["properties"].items()):
            value = F.try_variant_get(arguments, f"$['{parameter}']", "variant")
            kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
            missing = value.isNull() | (kind == "VOID")
            held = F.try_variant_get(arguments, f"$['{parameter}']", "string")
            number = F.try_variant_get(arguments, f"$['{parameter}']", "double")
            typed = kind.isin(KINDS[rules["type"]])
            if rules["type"] == "integer":
                typed &= number == F.rint(number)
            tests = []
            if parameter in schema.get("required", []):
                tests.append((missing, "missing"))
            tests.append((~missing & ~typed, "wrong type"))
            for keyword, test in (
                ("minLength", lambda x: F.length(held) < x),
                ("maxLength", lambda x: F.length(held) > x),
                ("minimum", lambda x: number < x),
                ("maximum", lambda x: number > x),
                ("enum", lambda x: ~_among(x, kind, held, number)),
            ):
                if keyword in rules:
                    tests.append((~missing & typed & test(rules[keyword]), keyword))
            found += [F.when((name == tool) & broken, F.lit(f"{parameter}: {what}")) for broken, what in tests]
    return F.array_compact(F.array(*found))


def _among(members: list, kind: Column, held: Column, number: Column) -> Column:
    """Whether a value equals one of these texts, numbers and booleans."""
    texts, flags = [m for m in members if isinstance(m, str)], ["true" if m else "false" for m in members if isinstance(m, bool)]
    numbers = [float(m) for m in members if isinstance(m, (int, float)) and not isinstance(m, bool)]
    return ((kind == "STRING") & held.isin(texts)) | ((kind == "BOOLEAN") & held.isin(flags)) | (kind.isin(NUMBERS) & number.isin(numbers))


def _order(calls: DataFrame) -> DataFrame:
    """``call_id, major, minor`` for every identifier; null for those on a cycle or after one."""
    spark = calls.sparkSession
    known = calls.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min("position").alias("position"))
    references = calls.select(F.col("call_id").alias("child"), F.explode("depends_on").alias("parent")).where("child IS NOT NULL AND parent IS NOT NULL")
    at = known.select(F.col("call_id").alias("parent"), F.col("position").alias("parent_position"))
    edges = references.join(at, "parent").join(known.select(F.col("call_id").alias("child"), "position"), "child").distinct()
    edges = stage(edges, "references")
    known = known.withColumns({"major": F.col("position"), "minor": F.lit(0).cast("long")})
    frontier = edges.where("parent_position >= position").select(F.col("child").alias("call_id")).distinct()
    if frontier.isEmpty():
        return known.select("call_id", "major", "minor")
    late, rounds = (frontier := stage(frontier, "late")), 0
    while not frontier.isEmpty():
        after = edges.join(frontier.withColumnRenamed("call_id", "parent"), "parent", "left_semi").select(F.col("child").alias("call_id")).distinct()
        frontier = stage(after.join(late, "call_id", "left_anti"), "late")
        late, rounds = _with(late, frontier, rounds)
    solved = stage(known.join(late, "call_id", "left_anti").select("call_id", "major", "minor"), "solved")
    own = stage(edges.join(late.withColumnRenamed("call_id", "child"), "child", "left_semi"), "late-references")
    rounds = 0
    while True:
        keyed = solved.select(F.col("call_id").alias("parent"), F.struct("major", (F.col("minor") + 1).alias("minor")).alias("key"))
        # of calls without an order yet, those whose parents all have one
        open_ = own.join(solved.select(F.col("call_id").alias("child")), "child", "left_anti")
        ready = open_.join(keyed, "parent", "left").groupBy("child", "position").agg(F.max("key").alias("key"), F.count_if(F.col("key").isNull()).alias("open"))
        ready = ready.where("open = 0").select(F.col("child").alias("call_id"), "position", "key")
        later = F.col("key.major") >= F.col("position")
        ready = stage(ready.select("call_id", F.when(later, F.col("key.major")).otherwise(F.col("position")).alias("major"), F.when(later, F.col("key.minor")).otherwise(0).alias("minor")), "ready")
        if ready.isEmpty():
            break
        solved, rounds = _with(solved, ready, rounds)
    return known.select("call_id").join(solved, "call_id", "left")


def _with(known: DataFrame, new: DataFrame, rounds: int) -> tuple[DataFrame, int]:
    """The rows known and the new ones, and the number of rounds. Only the new are written, and all of them every few rounds."""
    both = known.unionByName(new)
    return (stage(both, "rounds") if (rounds + 1) % ROUNDS == 0 else both), rounds + 1


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """A row for every call and for every result without a call.

    ``calls``: ``conversation, call_id, position, name, arguments`` (JSON), ``depends_on`` (array of ids).
    ``results``: ``call_id, position, content``. Gives ``conversation, call_id, name, major, minor, status``
    (linked, unanswered, orphan), ``n_results, valid, errors, json``.
    """
    calls = calls.select(
        "conversation", "call_id", F.coalesce("position", F.lit(0)).cast("long").alias("position"), "name", "arguments",
        F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"),
    )
    first = F.min(F.struct(F.coalesce("position", F.lit(0)).alias("position"), "content"))
    one = results.groupBy(F.col("call_id").alias("of_call")).agg(first.alias("result"), F.count("*").alias("n_results"))
    order = _order(calls).withColumnRenamed("call_id", "ordered")
    unknown = calls.select("call_id", F.explode("depends_on").alias("parent")).where("call_id IS NOT NULL")
    unknown = unknown.join(calls.select(F.col("call_id").alias("parent")).distinct(), "parent", "left_anti")
    unknown = unknown.groupBy(F.col("call_id").alias("lacking")).agg(F.sort_array(F.collect_set("parent")).alias("unknown"))
    # Without an identifier nothing is joined: such calls, and results that no call has, are put under the others
    named, unnamed = calls.where("call_id IS NOT NULL"), calls.where("call_id IS NULL")
    known = named.select("call_id").distinct()
    rows = named.join(one.where("of_call IS NOT NULL"), F.col("call_id") == F.col("of_call"), "left")
    rows = rows.join(order, F.col("call_id") == F.col("ordered"), "left").join(unknown, F.col("call_id") == F.col("lacking"), "left")
    rows = rows.unionByName(unnamed, allowMissingColumns=True).withColumn("is_call", F.lit(True))
    orphans = one.where("of_call IS NOT NULL").join(known.withColumnRenamed("call_id", "of_call"), "of_call", "left_anti")
    rows = rows.unionByName(orphans.unionByName(one.where("of_call IS NULL")), allowMissingColumns=True)
    rows = rows.withColumn("arguments", F.try_parse_json("arguments"))
    is_call = F.col("is_call").isNotNull()
    references = F.transform(F.coalesce("unknown", F.array().cast("array<string>")), lambda x: F.concat(F.lit("unknown call: "), x))
    cyclic = F.when(F.col("ordered").isNotNull() & F.col("major").isNull(), F.array(F.lit("cyclic references"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("errors", F.when(is_call, F.concat(errors(F.col("arguments"), F.col("name"), schemas), references, cyclic)))
    rows = rows.select(
        "conversation",
        F.coalesce("call_id", "of_call").alias("call_id"),
        "name",
        F.when(F.col("ordered").isNotNull(), F.col("major")).otherwise(F.col("position")).alias("major"),
        F.when(F.col("ordered").isNotNull(), F.col("minor")).when(is_call, F.lit(0)).alias("minor"),
        F.when(~is_call, "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked").alias("status"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.when(is_call, F.size("errors") == 0).alias("valid"),
        "errors",
        "arguments",
        "depends_on",
        F.col("result.content").alias("content"),
    )
    fields = F.struct("arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"))
    return rows.withColumn("json", canonical(F.to_json(fields, {"ignoreNullFields": "false"}))).drop("arguments", "depends_on", "content")
