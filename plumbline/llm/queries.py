"""The operators as queries on the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    decontamination,
    language_id,
    language_model,
    license_scan,
    merkle,
    mixing,
    near_duplicates,
    periodic_runs,
    quality_classifier,
    quality_rules,
    tool_calls,
    toxicity,
    wrappers,
)
from plumbline.llm.common import blank_words, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def register(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The given conversations have no tool calls. A user's turn is read as a call, the assistant's answer to it as its result. By a
# checksum of its identifier, a call refers to the user's next turn (0 to 3 of 10), or else to the one before, unless that refers
# forward itself (0 to 2; with 3 it does all the same, which makes a cycle).
CALL_SCHEMAS = {
    "ask": {
        "properties": {"query": {"type": "string", "minLength": 20, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0, "maximum": 1}},
        "required": ["query", "turn"],
    },
    "follow_up": {
        "properties": {"query": {"type": "string", "minLength": 20, "maxLength": 250}, "turn": {"type": "integer", "minimum": 2, "enum": [2, 3.0, 4, 5, 6, 8]}},
        "required": ["query", "turn"],
    },
}


def _crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""


CALLS_SQL = f"""
WITH RECURSIVE asked AS (
    SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id, {_crc_sql("conv_id || ':' || turn")} % 10 AS k,
           {_crc_sql("conv_id || ':' || (turn - 2)")} % 10 AS k_before
    FROM conversations WHERE role = 'user'),
calls AS (
    SELECT *, CASE WHEN turn < 2 THEN 'ask' ELSE 'follow_up' END AS name,
           CASE WHEN k <= 3 THEN turn + 2 WHEN turn >= 2 AND k_before > 2 THEN turn - 2 END AS refers,
           CASE WHEN refers IS NULL THEN []::VARCHAR[] ELSE [conv_id || ':' || refers] END AS depends_on
    FROM asked),
results AS (
    SELECT conv_id || ':' || (turn - 1) AS of_call, min(text) AS content, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY ALL),
sizes AS (SELECT conv_id, count(*) AS n FROM calls GROUP BY conv_id),
walk AS (
    SELECT call_id, conv_id, turn AS place, refers, 0::BIGINT AS steps FROM calls
    UNION ALL
    SELECT w.call_id, w.conv_id, c.turn, c.refers, steps + 1 FROM walk w JOIN calls c ON w.conv_id = c.conv_id AND w.refers = c.turn JOIN sizes s ON w.conv_id = s.conv_id
    WHERE steps <= n),
ordered AS (
    SELECT call_id, CASE WHEN max(steps) <= max(n) THEN max(place)::BIGINT END AS major, CASE WHEN max(steps) <= max(n) THEN arg_max(steps, place) END AS minor
    FROM walk JOIN sizes USING (conv_id) GROUP BY call_id),
checked AS (
    SELECT *, list_filter([
        CASE WHEN length(text) < 20 THEN 'query: minLength' END,
        CASE WHEN length(text) > CASE name WHEN 'ask' THEN 400 ELSE 250 END THEN 'query: maxLength' END,
        CASE WHEN turn >= 2 AND turn NOT IN (2, 3, 4, 5, 6, 8) THEN 'turn: enum' END,
        CASE WHEN refers IS NOT NULL AND depends_on[1] NOT IN (SELECT call_id FROM calls) THEN 'unknown call: ' || depends_on[1] END,
        CASE WHEN major IS NULL THEN 'cyclic references' END], lambda e: e IS NOT NULL) AS errors
    FROM calls JOIN ordered USING (call_id))
SELECT CASE WHEN call_id IS NOT NULL THEN conv_id END AS conv_id, coalesce(call_id, of_call) AS call_id, name, major, minor,
       CASE WHEN call_id IS NULL THEN 'orphan' WHEN of_call IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       coalesce(n_results, 0) AS n_results, CASE WHEN call_id IS NOT NULL THEN len(errors) = 0 END AS valid,
       array_to_string(errors, '; ') AS errors,
       CAST(to_json({{
           'arguments': CASE WHEN call_id IS NOT NULL THEN {{'query': text, 'turn': turn}} END,
           'depends_on': coalesce(depends_on, []::VARCHAR[]), 'id': coalesce(call_id, of_call), 'name': name, 'result': content}}) AS VARCHAR) AS json
FROM checked FULL OUTER JOIN results ON call_id = of_call
"""


@register(CALLS_SQL)
def op1_tool_calls(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    checksum = lambda turn: F.crc32(F.concat_ws(":", "conv_id", turn).cast("binary")) % 10
    turn, k, k_before = F.col("turn"), checksum(F.col("turn")), checksum(F.col("turn") - 2)
    refers = F.when(k <= 3, turn + 2).when((turn >= 2) & (k_before > 2), turn - 2)
    # whole numbers written as such and with a fraction of zero: the JSON has one form
    written = F.when(turn % 4 == 0, turn.cast("string")).otherwise(F.concat(turn.cast("string"), F.lit(".0")))
    calls = turns.where("role = 'user'").select(
        F.col("conv_id").alias("conversation"),
        F.concat_ws(":", "conv_id", "turn").alias("call_id"),
        turn.alias("position"),
        F.when(turn < 2, "ask").otherwise("follow_up").alias("name"),
        F.regexp_replace(F.to_json(F.struct("turn", F.col("text").alias("query"))), r'^\{"turn":[0-9]+', F.concat(F.lit('{"turn":'), written)).alias("arguments"),
        F.when(refers.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat_ws(":", "conv_id", refers))).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select(F.concat_ws(":", "conv_id", turn - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    linked = tool_calls.link(calls, results, CALL_SCHEMAS)
    return linked.withColumn("errors", F.array_join("errors", "; ")).withColumnRenamed("conversation", "conv_id")


@register()
def op2_quality_classifier(spark, sf_dir):
    scored = quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


# The words of a document, as windows of every length that an item's window has, looked up among the items'.
LEAKS_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS words, least(10, len(w)) AS n
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM w, lengths),
hits AS (
    SELECT doc_id, item_id, i, p.n FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM places) p
    JOIN windows USING (words)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@register()
def op3_license_scan(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register(LEAKS_SQL)
def op4_decontamination(spark, sf_dir):
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


MIXING_SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight,
           2.0::DOUBLE * source_size AS ceiling, 1.5::DOUBLE * sum(source_size) OVER () AS total
    FROM totals),
summed AS (
    SELECT *, coalesce(sum(ceiling) OVER before, 0.0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0) AS open
    FROM weighed
    WINDOW before AS (ORDER BY ceiling / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT arg_min((total - used) / open, ceiling / weight) AS level FROM summed WHERE (total - used) / open * weight <= ceiling),
targets AS (SELECT source, source_size, least(ceiling, coalesce(level * weight, ceiling)) AS target FROM summed, levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE
                                        < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""


@register(MIXING_SQL)
def op5_mixing(spark, sf_dir):
    drawn = mixing.with_copies(_table(spark, sf_dir, "documents"))
    return drawn.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@register()
def op6_language_model(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    scored = language_model.score(docs, remainder(docs["doc_id"], 7) != 2)
    return scored.select(
        F.col("id").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@register()
def op7_toxicity(spark, sf_dir):
    scored = toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


def _threshold_sql() -> str:
    return " AND ".join(f"{measure} {comparison} {threshold}" for _, measure, comparison, threshold in quality_rules.RULES)


RULES_SQL = rf"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS lines
    FROM documents),
windows AS (
    SELECT doc_id, i, w[i:i + 7] AS words_8 FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split)),
starts AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words_8) AS n FROM windows) WHERE n > 1),
covered AS (
    SELECT doc_id, CAST(sum(covers) AS BIGINT) AS n_repeat_words
    FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 8) - i) AS covers FROM starts) GROUP BY doc_id),
counted AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclamations,
           CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[ 	-
]*$'))) AS n_ellipsis_lines,
           len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted(set(quality_rules.STOP_WORDS)))}))) AS n_stop_words,
           len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_adjacent_repeats,
           coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM split LEFT JOIN covered USING (doc_id)),
ratios AS (
    SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_length,
           CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
           CASE WHEN n_words > 0 THEN n_exclamations / n_words ELSE 0 END AS exclamations_per_word,
           CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_ratio,
           CASE WHEN n_words > 0 THEN n_adjacent_repeats / n_words ELSE 0 END AS adjacent_repeat_ratio,
           CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS duplicate_line_ratio,
           CASE WHEN n_lines > 0 THEN n_ellipsis_lines / n_lines ELSE 0 END AS ellipsis_line_ratio,
           n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
    FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_threshold_sql()} AS kept FROM ratios
"""


@register(RULES_SQL)
def op8_quality_rules(spark, sf_dir):
    applied = quality_rules.apply_rules(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return applied.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register()
def op9_language_id(spark, sf_dir):
    return language_id.identify(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register()
def op10_near_duplicates(spark, sf_dir):
    found = near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), near_duplicates.hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


CRC_SQL = _crc_sql("coalesce(CAST(doc_id AS VARCHAR), '')")

LEAF_PARTS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf_sql(text: str) -> str:
    parts = [f"CAST({text if p == 'text' else p} AS VARCHAR)" for p in LEAF_PARTS]
    return "sha256(" + " || ".join(f"CASE WHEN {p} IS NULL THEN '-' ELSE strlen({p}) || ':' || {p} END" for p in parts) + ")"


# Levels by number: each groups three nodes of the one below. Then the siblings of every ancestor of a leaf.
MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
           CASE WHEN {CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS given
    FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS total FROM leaves),
lower AS (
    SELECT 0 AS level, source, place AS spot, total, leaf AS digest FROM placed
    UNION ALL
    SELECT any_value(level) + 1, source, spot // 3, any_value(total + 2) // 3, sha256(string_agg(digest, '' ORDER BY spot)) FROM lower WHERE total > 1 GROUP BY source, spot // 3),
subroots AS (
    SELECT source, digest, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM lower WHERE total = 1),
upper AS (
    SELECT 0 AS level, place AS spot, total, digest FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, spot // 3, any_value(total + 2) // 3, sha256(string_agg(digest, '' ORDER BY spot)) FROM upper WHERE total > 1 GROUP BY spot // 3),
lower_steps AS (
    SELECT n.source, n.level, n.spot, coalesce(string_agg(s.digest, '' ORDER BY s.spot) FILTER (s.spot < n.spot), '') AS before,
           coalesce(string_agg(s.digest, '' ORDER BY s.spot) FILTER (s.spot > n.spot), '') AS after
    FROM lower n JOIN lower s ON n.source IS NOT DISTINCT FROM s.source AND n.level = s.level AND n.spot // 3 = s.spot // 3 WHERE n.total > 1 GROUP BY ALL),
upper_steps AS (
    SELECT n.level, n.spot, coalesce(string_agg(s.digest, '' ORDER BY s.spot) FILTER (s.spot < n.spot), '') AS before,
           coalesce(string_agg(s.digest, '' ORDER BY s.spot) FILTER (s.spot > n.spot), '') AS after
    FROM upper n JOIN upper s ON n.level = s.level AND n.spot // 3 = s.spot // 3 WHERE n.total > 1 GROUP BY ALL),
walk AS (
    SELECT p.source, p.place AS leaf_at, 0 AS level, p.place AS spot, given AS digest, '' AS siblings, height, r.place AS top FROM placed p JOIN subroots r ON p.source IS NOT DISTINCT FROM r.source
    UNION ALL
    SELECT w.source, w.leaf_at, w.level + 1, CASE WHEN w.level + 1 = w.height THEN w.top ELSE w.spot // 3 END,
           sha256(coalesce(l.before, u.before) || w.digest || coalesce(l.after, u.after)), w.siblings || coalesce(l.before, u.before) || coalesce(l.after, u.after), w.height, w.top
    FROM (SELECT * REPLACE (CASE WHEN level = 0 AND height = 0 THEN top ELSE spot END AS spot) FROM walk) w
    LEFT JOIN lower_steps l ON w.level < w.height AND w.source IS NOT DISTINCT FROM l.source AND w.level = l.level AND w.spot = l.spot
    LEFT JOIN upper_steps u ON w.level >= w.height AND w.level - w.height = u.level AND w.spot = u.spot
    WHERE l.spot IS NOT NULL OR u.spot IS NOT NULL),
last AS (SELECT source, leaf_at, arg_max(digest, level) AS digest, arg_max(siblings, level) AS siblings FROM walk GROUP BY ALL)
SELECT p.doc_id, p.leaf, r.digest AS subroot, root, sha256(l.siblings) AS proof_sha256, l.digest AS folded_root, l.digest = root AS verified
FROM placed p JOIN subroots r ON p.source IS NOT DISTINCT FROM r.source JOIN last l ON p.source IS NOT DISTINCT FROM l.source AND p.place = l.leaf_at
CROSS JOIN (SELECT digest AS root FROM upper WHERE total = 1)
"""


@register(MERKLE_SQL)
def op12_merkle_manifest(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    original = merkle.leaf([docs[c] for c in LEAF_PARTS])
    tampered = merkle.leaf([F.replace(docs[c], F.lit("\n"), F.lit("")) if c == "text" else docs[c] for c in LEAF_PARTS])
    given = F.when(remainder(docs["doc_id"], 2) == 0, tampered).otherwise(original)
    made = merkle.manifest(docs, "source", "doc_id", original, {"given": given})
    root = merkle.folded(F.col("given"), F.col("way"))
    made = made.select(
        F.col("id").alias("doc_id"),
        merkle.as_hex(F.col("digest")).alias("leaf"),
        merkle.as_hex(F.col("subroot")).alias("subroot"),
        merkle.as_hex(F.col("root")).alias("root"),
        F.sha2(merkle.proof(F.col("way")), 256).alias("proof_sha256"),
        merkle.as_hex(root).alias("folded_root"),
    )
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


# Words that equal the one a lag on, in stretches; of stretches with equal ends that with the least lag.
RUNS_SQL = f"""
WITH split AS (SELECT doc_id, {CRC_SQL} AS h, {WORDS} AS w FROM documents),
sized AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
planted AS (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
               list_transform(range(1, n + 1), lambda i: w[CASE WHEN i > a THEN a + (i - 1 - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1 ELSE i END]) ELSE w END AS w
    FROM sized),
places AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM planted),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS lag FROM places x JOIN places y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS stretch FROM same),
runs AS (
    SELECT doc_id, start, length, min(lag) AS period
    FROM (SELECT doc_id, lag, min(i) AS start, count(*) + lag AS length FROM stretches GROUP BY doc_id, lag, stretch HAVING count(*) + lag >= greatest(6, 4 * lag))
    GROUP BY doc_id, start, length),
digests AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
           min({{'less': -(length::DECIMAL(38, 18) / period), 'start': start, 'period': period, 'length': length}}) AS best
    FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM planted LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@register(RUNS_SQL)
def op13_periodic_runs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    h = remainder(docs["doc_id"], 1 << 32)
    docs = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, blank_words(docs["text"])).alias("words"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    docs = docs.withColumn("p", period)
    repeated = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))).otherwise(w))
    text = F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))
    found = periodic_runs.find_runs(docs, text=text)
    # the greatest exact quotient: compared as fractions, ties to the earlier start, then the shorter period
    best = F.expr(
        "aggregate(runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>),"
        " (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)"
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# In the given tables the main text is the article element, of headings and paragraphs: what SQL can read. The operator
# knows nothing of this; its tests hold it to other markup.
PAGES_SQL = r"""
WITH articles AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS html FROM pages),
blocks AS (
    SELECT page_id, url, list_transform(string_split(regexp_replace(regexp_replace(replace(html, '<br>', ' '), '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)),
               lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))) AS blocks
    FROM articles),
decoded AS (
    SELECT page_id, url, regexp_replace(replace(replace(regexp_replace(replace(replace(array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10) || chr(10)),
               '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;?', '&', 'g') AS text
    FROM blocks)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM decoded
"""


@register(PAGES_SQL)
def op11_html_extraction(spark, sf_dir):
    found = wrappers.extract(_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
