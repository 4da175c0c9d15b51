"""DuckDB SQL giving the same rows as the registered queries, by plain definitions."""

from __future__ import annotations

from siftline.schemas import LABEL_NAMES
from siftline.catalog.inputs import BLANKS, TEMPLATE_OPERATORS
from siftline.functions.code import AST_FEATURES
from siftline.functions.text import WHITESPACE
from siftline.operators.repair_text import REVIEW_PROMPT


def text(value: str) -> str:
    """An SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


WS = text(WHITESPACE)
EDGE = text(BLANKS)
# Spelled out once more here, so that the check does not lean on the engine's own patterns.
AWARE_STRING = text("(?s)\"\"\".*?\"\"\"|'''.*?'''|\"[^\"\\n]*\"|'[^'\\n]*'")
AWARE_TOKEN = text(
    r"[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+(?:\.\p{Nd}+)?|\*\*|//|==|!=|<=|>=|\+=|-=|\*=|/=|%=|->|<<|>>"
    r"|[-+*/%<>&|!^~=:;,.()\[\]{}@]"
)
BLANK_RUN = text(
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
LINE_END = text(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")


def strip(value: str) -> str:
    return f"trim({value}, {WS})"


def rstrip(value: str) -> str:
    return f"rtrim({value}, {WS})"


def place(*keys: str) -> str:
    return "md5(concat_ws(':', '42', " + ", ".join(f"CAST({key} AS VARCHAR)" for key in keys) + "))"


LABEL = """CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 0 AND toxic = 0 THEN 1
 WHEN quality = 1 AND toxic = 1 THEN 2 ELSE 3 END"""
NAME = """CASE label WHEN 0 THEN 'Clean' WHEN 1 THEN 'Wrong Binary Operator'
 WHEN 2 THEN 'Variable Misuse' WHEN 3 THEN 'Swapped Operand' END"""
LABELLED = f"labelled AS (SELECT d.*, {LABEL} AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
ORDERS = """classed AS (SELECT o_orderkey, CASE WHEN o_orderkey % 20 < 9 THEN 0 WHEN o_orderkey % 20 < 13 THEN 1
 WHEN o_orderkey % 20 < 18 THEN 2 ELSE 3 END AS label FROM orders)"""
PREDICTED = f"""{LABELLED}, predicted AS (SELECT doc_id, label, CASE WHEN n_chars < 600 THEN 0
 WHEN n_chars < 1500 THEN 1 WHEN n_chars < 3500 THEN 2 ELSE 3 END AS prediction FROM labelled)"""
DISTRIBUTION = "count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct"

RAW = """raw AS (SELECT doc_id, text AS function,
 CASE WHEN doc_id % 7 < 3 THEN 'Correct' WHEN doc_id % 7 < 5 THEN CASE doc_id % 3 WHEN 0 THEN 'Wrong binary operator'
  WHEN 1 THEN 'Variable misuse' ELSE 'Swapped operands' END WHEN doc_id % 7 = 5 THEN 'Unknown' END AS label_text,
 CASE doc_id % 3 WHEN 0 THEN 'wrong_binary_operator_datasets' WHEN 1 THEN 'variable_misuse_datasets'
  ELSE 'swapped_operands_datasets' END AS source_task FROM documents)"""
MAPPED = f"""{RAW}, coded AS (SELECT doc_id, function, source_task,
 CASE WHEN label_text = 'Correct' THEN 0 ELSE CAST(doc_id % 3 + 1 AS INTEGER) END AS label
 FROM raw WHERE label_text <> 'Unknown'),
 mapped AS (SELECT *, {NAME} AS bug_type FROM coded)"""

OPERATOR = "[" + ", ".join(text(operator) for operator in TEMPLATE_OPERATORS) + "][o_custkey % 12 + 1]"
CODE = f"""code AS (SELECT o_orderkey, 'def f_' || o_orderkey || E'(a, b):\\n'
 || CASE WHEN o_orderkey % 3 = 0 THEN E'    if a == 0 and not b:\\n        return 10\\n' ELSE '' END
 || '    return ' || CASE WHEN o_orderkey % 4 = 3 THEN 'b' ELSE 'a' END || ' ' || {OPERATOR} || ' '
 || CASE WHEN o_orderkey % 4 = 3 THEN 'a' ELSE 'b' END || E'\\n' AS code FROM orders)"""

DIFFS = """order_sides AS (SELECT o_orderkey, '    return a + v_' || (o_custkey % 500) AS old FROM orders),
diffs AS (SELECT (u.conv_id * 1000 + u.turn) * 2 + 1 AS record_id,
  E'--- a/x\\n+++ b/x\\n@@ -1 +1 @@\\n def f():  \\n-' || replace(u.text, E'\\n', E' \\n-')
  || E'\\n+' || replace(a.text, E'\\n', E'\\n+') || E'\\n\\\\ No newline at end of file' AS diff
 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
 WHERE u.role = 'user' AND a.role = 'assistant'
 UNION ALL
 SELECT o_orderkey * 2, E'--- a/m.py\\r\\n+++ b/m.py\\r\\n@@ -1,3 +1,3 @@\\r\\n def g(a):\\r\\n'
  || CASE WHEN o_orderkey % 10 = 0 THEN '+' ELSE '-' || old END || E'  \\r\\n+'
  || CASE WHEN o_orderkey % 6 = 0 THEN old ELSE replace(old, '+', '-') END || E'\\r\\n # end'
 FROM order_sides)"""


def sides(loose: bool) -> str:
    cut = rstrip("substr(x, 2)") if loose else "substr(x, 2)"

    def side(mark: str) -> str:
        marked = f"list_transform(list_filter(body, lambda x: starts_with(x, '{mark}')), lambda x: {cut})"
        return strip(f"array_to_string({marked}, chr(10))")

    shown = f"""list_transform(list_filter(body, lambda x: NOT starts_with(x, '+')), lambda x:
 CASE WHEN starts_with(x, '-') OR starts_with(x, ' ') THEN {cut} ELSE {rstrip('x')} END)"""
    return f"""{DIFFS}, split AS (SELECT record_id, string_split_regex(diff, {LINE_END}) AS raw_lines FROM diffs),
 bodies AS (SELECT record_id, list_filter(
  CASE WHEN raw_lines[-1] = '' THEN raw_lines[1:len(raw_lines) - 1] ELSE raw_lines END,
  lambda x: NOT (starts_with(x, '---') OR starts_with(x, '+++') OR starts_with(x, '@@'))) AS body FROM split),
 sides AS (SELECT record_id, {side('-')} AS buggy, {side('+')} AS fixed,
  {strip(f"array_to_string({shown}, chr(10))")} AS input_with_context FROM bodies)"""


def records(loose: bool) -> str:
    pattern = "slot IN (1, 3) OR slot >= 4" if loose else "slot >= 4"
    flag = "kind IN (1, 2, 7, 9) OR kind >= 11" if loose else "kind >= 11"
    size = "length(input_with_context) <= 600" if loose else "length(buggy) <= 400"
    return f"""{sides(loose)}, records AS (SELECT *, record_id % 9 AS slot, record_id % 17 AS kind FROM sides
  WHERE record_id % 29 <> 0 AND record_id % 31 <> 0 AND record_id % 37 <> 0 AND record_id % 41 <> 0),
 judged AS (SELECT *, ({pattern}) AS a, ({flag}) AS b, (buggy <> '' AND fixed <> '') AS c, buggy <> fixed AS d,
  {size} AS e, CASE slot WHEN 1 THEN '  ' WHEN 3 THEN '5' ELSE 'CHANGE_' || slot END AS sstub_pattern FROM records)"""


def pairs(loose: bool) -> str:
    shown = "input_with_context" if loose else "buggy"
    return f"""{records(loose)}, pairs AS (SELECT {shown} AS input_text, fixed AS target_text, sstub_pattern,
  md5(buggy) AS pair_hash FROM judged WHERE a AND b AND c AND d AND e
  QUALIFY row_number() OVER (PARTITION BY md5(buggy) ORDER BY record_id) = 1)"""


def md5_of(*names: str, size: bool = False) -> str:
    parts = []
    for name in names:
        parts.append(f"md5({name}) AS {name}_md5")
        if size:
            parts.append(f"CAST(length({name}) AS INTEGER) AS {name}_size")
    return ", ".join(parts)


# Legacy tokens step by step: mask strings, mask words made of digits, space out, split.
def legacy_tokens(value: str) -> str:
    masked = f"""regexp_replace({value}, '"[^\\n]*?"|''[^\\n]*?''', ' STR ', 'g')"""
    runs = f"regexp_extract_all({masked}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]')"
    numbered = f"""array_to_string(list_transform({runs}, lambda r:
 CASE WHEN regexp_full_match(r, '\\p{{Nd}}+') AND r NOT IN ('0', '1') THEN ' NUM ' ELSE r END), '')"""
    spaced = f"regexp_replace({numbered}, '([=+\\-*/%<>&!|:;{{}}()\\[\\]])', ' \\1 ', 'g')"
    return f"list_filter(string_split_regex({spaced}, {BLANK_RUN}), lambda t: t <> '')"


def aware_tokens(value: str) -> str:
    masked = f"regexp_replace({value}, {AWARE_STRING}, 'STR', 'g')"
    return f"regexp_extract_all({masked}, {AWARE_TOKEN})"


def digest(tokens) -> str:
    return f"""WITH {CODE}, texts AS (SELECT 'page ' || page_id AS key, html AS body FROM pages
 UNION ALL SELECT 'doc ' || doc_id, text FROM documents UNION ALL SELECT 'order ' || o_orderkey, code FROM code),
 tokenised AS (SELECT key, {tokens('body')} AS tokens FROM texts)
 SELECT key, CAST(len(tokens) AS INTEGER) AS n_tokens, md5(array_to_string(tokens, chr(10))) AS tokens_md5
 FROM tokenised"""


def grams(tokens: str, longest: int) -> str:
    parts = [tokens]
    for width in range(2, longest + 1):
        joined = " || ' ' || ".join(f"{tokens}[i + {at}]" for at in range(width))
        parts.append(f"list_transform(range(1, len({tokens}) - {width - 2}), lambda i: {joined})")
    built = parts[0]
    for part in parts[1:]:
        built = f"list_concat({built}, {part})"
    return built


def document_terms(source: str, key: str, tokens: str, longest: int) -> str:
    """CTEs up to ``tfs``: (key, term, tf)."""
    leads = ", ".join(
        f"lead(tok, {step}) OVER (PARTITION BY {key} ORDER BY pos) AS next{step}" for step in range(1, longest)
    )
    unions = ["SELECT {k}, tok AS term FROM ahead".format(k=key)]
    for width in range(2, longest + 1):
        joined = "tok || ' ' || " + " || ' ' || ".join(f"next{step}" for step in range(1, width))
        unions.append(f"SELECT {key}, {joined} FROM ahead WHERE next{width - 1} IS NOT NULL")
    lead_columns = f", {leads}" if leads else ""
    return f"""lists AS (SELECT {key}, {tokens} AS tokens FROM {source}),
 placed AS (SELECT {key}, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM lists),
 ahead AS (SELECT {key}, tok, pos{lead_columns} FROM placed),
 tfs AS (SELECT {key}, term, count(*) AS tf FROM ({' UNION ALL '.join(unions)}) GROUP BY ALL)"""


def vocabulary(where: str, min_df: int, size: int) -> str:
    return f"""stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tfs WHERE {where} GROUP BY term),
 top AS (SELECT * FROM stats WHERE df >= {min_df} ORDER BY cf DESC, term LIMIT {size}),
 vocab AS (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, term, df, cf FROM top)"""


def weights(source: str, key: str, where: str, tf: str) -> str:
    return f"""size AS (SELECT count(*) AS n FROM {source} WHERE {where}),
 weighted AS (SELECT {key}, t.term, {tf} * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w
  FROM tfs t JOIN vocab v ON t.term = v.term, size)
 SELECT {key}, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY {key})), 6) AS weight FROM weighted"""


def ast_columns() -> str:
    names = ("Add", "Sub", "Mult", "Div", "Mod", "Pow", "FloorDiv", "BitAnd", "BitOr", "BitXor", "LShift", "RShift")
    guarded = "o_orderkey % 3 = 0"
    values = {f"op_{name}": f"CASE WHEN o_custkey % 12 = {at} THEN 1 ELSE 0 END" for at, name in enumerate(names)}
    for name in ("cmp_Eq", "bool_And", "unary_Not", "if_count"):
        values[name] = f"CASE WHEN {guarded} THEN 1 ELSE 0 END"
    values["return_count"] = f"CASE WHEN {guarded} THEN 2 ELSE 1 END"
    values["total_vars"] = f"CASE WHEN {guarded} THEN 4 ELSE 2 END"
    values["unique_vars"] = "2"
    values["var_repeat_ratio"] = f"CASE WHEN {guarded} THEN 2 ELSE 1 END"
    return ", ".join(f"CAST({values.get(name, '0')} AS DOUBLE) AS {name}" for name in AST_FEATURES)


def quota_fill(source: str, label: str, total: int, named: dict[str, int]) -> str:
    """CTEs up to ``quotas``: (label, quota) of the quota-then-fill rule."""
    want = "CASE " + label + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in named.items()) + " END"
    return f"""totals AS (SELECT {label}, count(*) AS n, {want} AS want FROM {source} GROUP BY {label}),
 shares AS (SELECT *, {total} - sum(CASE WHEN want IS NOT NULL THEN least(want, n) ELSE 0 END) OVER () AS remainder,
   sum(CASE WHEN want IS NULL THEN n ELSE 0 END) OVER () AS pool FROM totals),
 rounded AS (SELECT *, CASE WHEN want IS NULL THEN
   least(n, CAST(round_even(CAST(remainder AS DOUBLE) * n / pool, 0) AS BIGINT)) END AS share FROM shares),
 gaps AS (SELECT *, remainder - sum(share) OVER () AS gap FROM rounded),
 movable AS (SELECT *, row_number() OVER (PARTITION BY
   coalesce(CASE WHEN gap > 0 THEN share < n ELSE share > 0 END, FALSE) ORDER BY {label}) AS pos,
   coalesce(CASE WHEN gap > 0 THEN share < n ELSE share > 0 END, FALSE) AS moves FROM gaps),
 quotas AS (SELECT {label}, CASE WHEN want IS NOT NULL THEN least(want, n)
   ELSE share + CASE WHEN moves AND pos <= abs(gap) THEN sign(gap) ELSE 0 END END AS quota FROM movable)"""


def holdout(source: str, label: str, key: str, k: int, per_class: int, total: int) -> str:
    """CTEs up to ``held``: keys of the balanced holdout."""
    return f"""sizes AS (SELECT {label}, count(*) AS n FROM {source} GROUP BY {label} ORDER BY n DESC, {label} LIMIT {k}),
 ranked AS (SELECT s.*, n IS NOT NULL AND
   row_number() OVER (PARTITION BY s.{label} ORDER BY {place(f's.{key}')}, s.{key}) <= {per_class} AS picked
   FROM {source} s LEFT JOIN sizes z ON s.{label} = z.{label}),
 held AS (SELECT {label}, {key} FROM ranked WHERE picked UNION ALL (SELECT {label}, {key} FROM (
   SELECT *, row_number() OVER (ORDER BY {place(key)}, {key}) AS pos FROM ranked WHERE NOT picked)
   WHERE pos <= {total} - (SELECT count(*) FROM ranked WHERE picked)))"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # ---- curation
    first = "row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1"
    sql["curated_distribution"] = f"""WITH {LABELLED}, firsts AS (SELECT * FROM labelled QUALIFY {first}),
 counts AS (SELECT label, {DISTRIBUTION} FROM firsts GROUP BY label)
 SELECT label, n, pct, {NAME} AS bug_type FROM counts"""
    sql["class_distribution_orders"] = f"WITH {ORDERS} SELECT label, {DISTRIBUTION} FROM classed GROUP BY label"
    sql["dedupe_first"] = f"SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents QUALIFY {first}"
    sql["dedupe_clean"] = f"""WITH {MAPPED} SELECT doc_id, label, bug_type FROM mapped
 QUALIFY label <> 0 OR row_number() OVER (PARTITION BY label, function ORDER BY doc_id) = 1"""
    sql["map_labels"] = f"WITH {MAPPED} SELECT doc_id, label, bug_type, source_task FROM mapped"
    sql["skipped_labels"] = f"""WITH {RAW} SELECT source_task, count(*) AS skipped FROM raw
 WHERE label_text IS NULL OR label_text = 'Unknown' GROUP BY source_task"""
    sql["labelled_splits"] = f"""WITH {MAPPED} SELECT source_task, label, bug_type, md5(function) AS function_md5,
 CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM mapped"""
    sql["label_counters"] = f"""WITH {RAW} SELECT count(*) AS total,
 count(*) FILTER (label_text IS NULL OR label_text = 'Unknown') AS skipped,
 count(*) FILTER (label_text = 'Correct') AS clean FROM raw"""
    sql["union_all"] = f"WITH {MAPPED} SELECT label, {DISTRIBUTION} FROM mapped GROUP BY label"
    sql["label_names"] = f"WITH {LABELLED} SELECT doc_id, label, {NAME} AS bug_type FROM labelled"
    sql["event_type_counts"] = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"
    sql["most_common_users"] = (
        "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10"
    )
    sql["class_weights"] = f"""WITH {ORDERS}, totals AS (SELECT label, count(*) AS n FROM classed GROUP BY label)
 SELECT o_orderkey, label, round(CAST((SELECT count(*) FROM classed) AS DOUBLE) / ((SELECT count(*) FROM totals) * n), 9)
 AS weight FROM classed JOIN totals USING (label)"""
    hashed = "hashed AS (SELECT doc_id, md5(text) AS text_md5 FROM documents)"
    sql["exclude_seen"] = f"""WITH {hashed} SELECT doc_id, text_md5 FROM hashed WHERE doc_id % 3 <> 0
 AND text_md5 NOT IN (SELECT text_md5 FROM hashed WHERE doc_id % 3 = 0)"""
    sql["overlap_keys"] = f"""WITH {hashed} SELECT text_md5 FROM hashed WHERE doc_id % 3 = 0
 INTERSECT SELECT text_md5 FROM hashed WHERE doc_id % 3 <> 0"""

    # ---- sampling
    def sample(source: str, label: str, key: str, target: int) -> str:
        return f"""totals AS (SELECT {label}, count(*) AS n FROM {source} GROUP BY {label}),
 quotas AS (SELECT {label}, least(n, greatest(1, round_even(n * (CAST({target} AS DOUBLE) / sum(n) OVER ()), 0))) AS quota
  FROM totals), ranked AS (SELECT s.*, quota, row_number() OVER (PARTITION BY s.{label}
  ORDER BY {place('s.' + key)}, s.{key}) AS pos FROM {source} s JOIN quotas q ON s.{label} = q.{label})"""

    sql["stratified_sample"] = f"""WITH {ORDERS}, {sample('classed', 'label', 'o_orderkey', 1000)}
 SELECT o_orderkey, label FROM ranked WHERE pos <= quota"""
    sql["stratified_sample_documents"] = f"""WITH {sample('documents', 'lang', 'doc_id', 150)}
 SELECT doc_id, lang, n_chars FROM ranked WHERE pos <= quota"""
    sql["stratified_split"] = f"""WITH {ORDERS}, totals AS (SELECT label, count(*) AS n FROM classed GROUP BY label),
 sized AS (SELECT *, sum(n) OVER () AS all_rows, CAST(ceil(sum(n) OVER () * 0.2) AS BIGINT) AS test_rows FROM totals),
 based AS (SELECT *, (n * test_rows) // all_rows AS base, (n * test_rows) % all_rows AS rest FROM sized),
 quotas AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
   <= test_rows - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM based)
 SELECT o_orderkey, c.label, row_number() OVER (PARTITION BY c.label ORDER BY {place('o_orderkey')}, o_orderkey)
  <= quota AS in_test FROM classed c JOIN quotas q ON c.label = q.label"""
    fill = quota_fill("orders", "o_orderpriority", 2000, {"1-URGENT": 300, "2-HIGH": 200})
    sql["quota_sample"] = f"""WITH {fill} SELECT o_orderkey, o.o_orderpriority FROM orders o
 JOIN quotas q ON o.o_orderpriority = q.o_orderpriority QUALIFY row_number() OVER
 (PARTITION BY o.o_orderpriority ORDER BY {place('o_orderkey')}, o_orderkey) <= quota"""
    sql["balanced_holdout"] = f"""WITH buckets AS (SELECT o_orderkey, o_custkey % 37 AS bucket FROM orders),
 {holdout('buckets', 'bucket', 'o_orderkey', 10, 30, 1000)} SELECT o_orderkey, bucket FROM held"""
    line_key = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    sql["take_split"] = f"""WITH placed AS (SELECT {line_key}, row_number() OVER (ORDER BY
 {place(*line_key.split(', '))}, {line_key}) AS pos FROM lineitem)
 SELECT {line_key}, CASE WHEN pos <= 20000 THEN 'train' ELSE 'val' END AS part FROM placed WHERE pos <= 25000"""
    lines = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag"

    def lines_in_order(*key: str) -> str:
        return f"""row_number() OVER (PARTITION BY l_returnflag ORDER BY {place(*key)}, {', '.join(key)},
 {place(*lines.split(', '))}, {lines}) AS pos"""

    sql["stratified_sample_lines"] = f"""WITH totals AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag),
 quotas AS (SELECT l_returnflag, least(n, greatest(1, round_even(n * (CAST(3001 AS DOUBLE) / sum(n) OVER ()), 0))) AS quota FROM totals),
 ranked AS (SELECT {lines}, {lines_in_order('l_orderkey', 'l_linenumber')} FROM lineitem)
 SELECT {lines} FROM ranked JOIN quotas USING (l_returnflag) WHERE pos <= quota"""
    sql["split_lines_by_order"] = f"""WITH totals AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag),
 sized AS (SELECT *, sum(n) OVER () AS all_rows, CAST(ceil(sum(n) OVER () * 0.2) AS BIGINT) AS test_rows FROM totals),
 based AS (SELECT *, (n * test_rows) // all_rows AS base, (n * test_rows) % all_rows AS rest FROM sized),
 quotas AS (SELECT l_returnflag, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, l_returnflag)
   <= test_rows - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM based),
 ranked AS (SELECT {lines}, {lines_in_order('l_orderkey')} FROM lineitem)
 SELECT {lines}, pos <= quota AS in_test FROM ranked JOIN quotas USING (l_returnflag)"""
    sql["take_split_without_key"] = f"""WITH placed AS (SELECT l_returnflag, l_linenumber, row_number() OVER (ORDER BY
 {place('l_returnflag', 'l_linenumber')}, l_returnflag, l_linenumber) AS pos FROM lineitem)
 SELECT l_returnflag, l_linenumber, CASE WHEN pos <= 2500 THEN 'train' ELSE 'val' END AS part FROM placed WHERE pos <= 3200"""
    sql["seeded_order"] = f"SELECT doc_id, {place('doc_id')} AS place FROM documents"
    sql["example_rows"] = f"SELECT doc_id, lang FROM documents ORDER BY {place('doc_id')}, doc_id LIMIT 3"

    # ---- diffs and records
    sql["extract_diff_strict"] = f"WITH {sides(False)} SELECT record_id, {md5_of('buggy', 'fixed', size=True)} FROM sides"
    sql["extract_diff_loose"] = f"""WITH {sides(True)} SELECT record_id,
 {md5_of('input_with_context', 'buggy', 'fixed', size=True)} FROM sides"""
    for mode, loose in (("strict", False), ("loose", True)):
        sql[f"record_filter_{mode}"] = f"WITH {records(loose)} SELECT record_id, sstub_pattern FROM judged WHERE a AND b"
        sql[f"mine_fix_pairs_{mode}"] = f"""WITH {pairs(loose)} SELECT {md5_of('input_text', 'target_text')},
 sstub_pattern, pair_hash FROM pairs"""
    sql["changed_and_short"] = f"""WITH {sides(False)} SELECT record_id FROM sides
 WHERE buggy <> '' AND fixed <> '' AND buggy <> fixed AND length(buggy) <= 400"""
    sql["filter_funnel"] = f"""WITH {records(False)} SELECT count(*) AS raw, count(*) FILTER (a) AS specific_pattern,
 count(*) FILTER (a AND b) AS likely_bug, count(*) FILTER (a AND b AND c) AS both_sides,
 count(*) FILTER (a AND b AND c AND d) AS changed, count(*) FILTER (a AND b AND c AND d AND e) AS short_enough,
 count(DISTINCT md5(buggy)) FILTER (a AND b AND c AND d AND e) AS distinct_pairs FROM judged"""
    fill = quota_fill("pairs", "sstub_pattern", 600, {"CHANGE_4": 100, "CHANGE_5": 80})
    sql["fix_sets_strict"] = f"""WITH {pairs(False)}, {fill},
 train AS (SELECT p.pair_hash FROM pairs p JOIN quotas q ON p.sstub_pattern = q.sstub_pattern
  QUALIFY row_number() OVER (PARTITION BY p.sstub_pattern ORDER BY {place('pair_hash')}, pair_hash) <= quota),
 left_over AS (SELECT * FROM pairs WHERE pair_hash NOT IN (SELECT pair_hash FROM train)),
 {holdout('left_over', 'sstub_pattern', 'pair_hash', 3, 20, 100)}
 SELECT pair_hash, 'train' AS part FROM train UNION ALL SELECT pair_hash, 'val' FROM held"""
    sql["fix_sets_loose"] = f"""WITH {pairs(True)}, placed AS (SELECT pair_hash,
 row_number() OVER (ORDER BY {place('pair_hash')}, pair_hash) AS pos FROM pairs)
 SELECT pair_hash, CASE WHEN pos <= 400 THEN 'train' ELSE 'val' END AS part FROM placed WHERE pos <= 500"""
    sql["parse_json_safe"] = """SELECT event_id,
 CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events"""
    sql["lint_findings"] = """SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 0 END AS position,
 CASE WHEN p_partkey % 4 < 2 THEN p_size END AS line, CASE WHEN p_partkey % 4 < 2 THEN p_brand END AS symbol FROM part
 UNION ALL SELECT p_partkey, 1, p_size, p_brand FROM part WHERE p_partkey % 4 = 0"""
    sql["source_files"] = """SELECT s_suppkey, md5(E'def f():\\n    return \\'' || s_name || E'\\'\\n# end\\n') AS code_md5 FROM supplier"""
    sql["write_once_read_back"] = "SELECT o_orderkey, o_custkey, TRUE AS first, FALSE AS second FROM orders"
    edged = f"{EDGE} || text || {EDGE}"
    sql["csv_round_trip"] = f"SELECT doc_id, md5({edged}) AS text_md5 FROM documents"

    # ---- text
    sql["text_strip"] = f"""WITH edged AS (SELECT doc_id, {edged} AS text FROM documents)
 SELECT doc_id, md5({strip('text')}) AS stripped_md5, CAST(length({strip('text')}) AS INTEGER) AS stripped_size,
 CAST(length({rstrip('text')}) AS INTEGER) AS rstripped_size FROM edged"""
    sql["text_lines"] = f"""WITH split AS (SELECT doc_id,
 string_split_regex(replace(text, ' ', chr(8232)), {LINE_END}) AS parts FROM documents),
 lined AS (SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS lines FROM split)
 SELECT doc_id, CAST(len(lines) AS INTEGER) AS n_lines, md5(array_to_string(lines, '|')) AS lines_md5 FROM lined"""
    sql["drop_blank"] = f"""WITH texts AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {EDGE} ELSE text END AS code
 FROM documents) SELECT doc_id FROM texts WHERE {strip('code')} <> ''"""
    sql["tokens_legacy"] = digest(legacy_tokens)
    sql["tokens_bug_aware"] = digest(aware_tokens)
    sql["ngram_runs"] = f"""WITH tokenised AS (SELECT doc_id, {aware_tokens('lower(text)')} AS tokens FROM documents),
 built AS (SELECT doc_id, {grams('tokens', 4)} AS grams FROM tokenised)
 SELECT doc_id, CAST(len(grams) AS INTEGER) AS n_grams, md5(array_to_string(grams, chr(10))) AS grams_md5 FROM built"""

    # ---- features
    aware_terms = document_terms("documents", "doc_id", aware_tokens("lower(text)"), 2)
    legacy_terms = document_terms("code", "o_orderkey", legacy_tokens("lower(code)"), 4)
    sql["term_stats"] = f"""WITH {aware_terms} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf
 FROM tfs GROUP BY term"""
    sql["document_terms"] = f"WITH {aware_terms} SELECT doc_id, term, tf FROM tfs"
    sql["vocabulary_bug_aware"] = f"WITH {aware_terms}, {vocabulary('TRUE', 2, 20000)} SELECT idx, term, df, cf FROM vocab"
    sql["vocabulary_legacy"] = (
        f"WITH {CODE}, {legacy_terms}, {vocabulary('TRUE', 3, 15000)} SELECT idx, term, df, cf FROM vocab"
    )
    long_terms = document_terms("documents", "doc_id", legacy_tokens("lower(text)"), 4)
    sql["vocabulary_pruned"] = f"WITH {long_terms}, {vocabulary('TRUE', 3, 2000)} SELECT idx, term, df, cf FROM vocab"
    sql["tfidf_bug_aware"] = f"""WITH {aware_terms}, {vocabulary('doc_id % 5 <> 0', 2, 20000)},
 {weights('documents', 'doc_id', 'doc_id % 5 <> 0', '(1.0 + ln(tf))')}"""
    sql["tfidf_legacy"] = f"""WITH {CODE}, {legacy_terms}, {vocabulary('TRUE', 3, 15000)},
 {weights('code', 'o_orderkey', 'TRUE', 'tf')}"""
    words = document_terms("documents", "doc_id", aware_tokens("lower(text)"), 1)
    sql["encode_fixed"] = f"""WITH {words}, {vocabulary('TRUE', 2, 20000)},
 known AS (SELECT doc_id, list(idx + 1 ORDER BY pos) AS ids FROM placed JOIN vocab ON tok = term GROUP BY doc_id),
 coded AS (SELECT d.doc_id, coalesce(ids, []) AS ids FROM documents d LEFT JOIN known k ON d.doc_id = k.doc_id)
 SELECT doc_id, array_to_string(list_resize(ids, 256, 0), ',') AS input_ids,
 array_to_string(list_resize(list_transform(ids, lambda x: 1), 256, 0), ',') AS attention_mask,
 array_to_string(list_resize(ids, 128, -100), ',') AS labels FROM coded"""
    sql["forest_scores"] = """SELECT o_orderkey, CAST(o_orderkey % 4 = 3 AS INTEGER) AS label,
 CAST(o_orderkey % 4 = 3 AS INTEGER) AS is_buggy FROM orders"""
    # every tagged order is told right, so the report is that of the split: a fifth of all orders, by largest remainder
    sql["classifier_run"] = """WITH sizes AS (SELECT o_orderkey % 4 AS label, count(*) AS n FROM orders GROUP BY 1),
 goal AS (SELECT label, n, CAST(ceil(sum(n) OVER () * 0.2) AS BIGINT) AS t, CAST(sum(n) OVER () AS BIGINT) AS whole FROM sizes),
 parts AS (SELECT label, t, n * t // whole AS base, n * t % whole AS rest FROM goal),
 dealt AS (SELECT label, base + CAST(row_number() OVER (ORDER BY rest DESC, label) <= t - sum(base) OVER () AS INTEGER) AS support FROM parts),
 named AS (SELECT CAST(label AS VARCHAR) AS "row", support FROM dealt
  UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT sum(support) FROM dealt))
 SELECT "row", CAST(1.0 AS DOUBLE) AS precision, CAST(1.0 AS DOUBLE) AS recall, CAST(1.0 AS DOUBLE) AS f1,
  CAST(support AS BIGINT) AS support FROM named"""
    sql["saved_pipeline"] = """SELECT o_orderkey, CAST(o_orderkey % 4 = 3 AS INTEGER) AS label,
 CAST(o_orderkey % 4 = 3 AS INTEGER) AS prediction FROM orders"""
    names = " ".join(f"WHEN {code} THEN '{name}'" for code, name in LABEL_NAMES.items())
    sql["boosted_scores"] = f"""WITH t AS (SELECT o_orderkey, CAST(o_orderkey % 4 AS INTEGER) AS label FROM orders)
 SELECT o_orderkey, label, label AS prediction, CASE label {names} END AS bug_type, label <> 0 AS pass_on FROM t"""
    chosen = lambda some: f"list_extract([{', '.join(text(o) for o in some)}], CAST(o_custkey % {len(some)} AS INTEGER) + 1)"
    functions = f"""classed AS (SELECT o_orderkey, CAST(o_orderkey % 4 AS INTEGER) AS label,
  CASE WHEN o_orderkey % 4 = 1 THEN {chosen(TEMPLATE_OPERATORS[7:])} ELSE {chosen(TEMPLATE_OPERATORS[:5])} END AS op FROM orders),
 bodies AS (SELECT o_orderkey, label, 'return ' || CASE WHEN label = 3 THEN 'b' ELSE 'a' END || ' ' || op || ' ' ||
  CASE WHEN label IN (2, 3) THEN 'a' ELSE 'b' END AS body FROM classed),
 functions AS (SELECT o_orderkey, label, CAST(ordinal AS INTEGER) AS ordinal, CASE ordinal WHEN 0 THEN 'f_' ELSE 'g_' END || o_orderkey AS function_name,
  'def ' || CASE ordinal WHEN 0 THEN 'f_' ELSE 'g_' END || o_orderkey || E'(a, b):\\n' || CASE ordinal WHEN 0 THEN '    ' ELSE '        ' END || body
  AS function_code FROM bodies, range(2) t(ordinal))"""
    sql["review_binary"] = f"""WITH {functions} SELECT o_orderkey, ordinal, function_name, function_code, CAST(label = 3 AS INTEGER) AS is_buggy,
 CASE WHEN label = 3 THEN 'BUGGY' ELSE 'CLEAN' END AS status, CASE WHEN label = 3 THEN 'fix: ' || function_code END AS repair_input,
 label = 3 AS above_threshold FROM functions"""
    sql["review_streamed"] = f"""WITH {functions} SELECT o_orderkey, ordinal, function_name, CAST(label = 3 AS INTEGER) AS is_buggy,
 CASE WHEN label = 3 THEN 'BUGGY' ELSE 'CLEAN' END AS status, 1 AS deaths FROM functions"""
    sql["review_multiclass"] = f"""WITH {functions} SELECT o_orderkey, ordinal, function_name, function_code, label AS prediction,
 CASE label {names} END AS bug_type, label <> 0 AS pass_on, CASE WHEN label <> 0 THEN 'fix: ' || function_code END AS repair_input,
 TRUE AS sure FROM functions"""
    sql["ast_features"] = f"SELECT o_orderkey, {ast_columns()} FROM orders"
    whole = "o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0"
    sql["extract_functions"] = f"""SELECT o_orderkey, 0 AS ordinal, 'top_' || o_orderkey AS function_name,
 'def top_' || o_orderkey || E'(a, b):\\n    return a + b' AS function_code FROM orders WHERE {whole}
 UNION ALL SELECT o_orderkey, 1, 'm_' || o_orderkey, 'def m_' || o_orderkey ||
 E'(self):\\n        def inner(x):\\n            return x\\n        return inner(1)' FROM orders WHERE {whole}
 UNION ALL SELECT o_orderkey, 2, 'inner', E'def inner(x):\\n            return x' FROM orders WHERE {whole}
 UNION ALL SELECT o_orderkey, 0, 'UserSnippet', CASE WHEN o_orderkey % 7 = 0 THEN 'def broken_' || o_orderkey || E'(:\\n'
 ELSE 'x = ' || o_orderkey || E'\\n' END FROM orders WHERE NOT ({whole})"""
    sql["extract_functions_sql"] = sql["extract_functions"]

    # ---- evaluation
    sql["accuracy"] = f"""WITH {PREDICTED} SELECT
 round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM predicted"""
    cells = ", ".join(f"count(*) FILTER (prediction = {code}) AS predicted_{code}" for code in range(4))
    filled = ", ".join(f"coalesce(predicted_{code}, 0) AS predicted_{code}" for code in range(4))
    sql["confusion_matrix"] = f"""WITH {PREDICTED}, rows_of AS (SELECT label, {cells} FROM predicted GROUP BY label)
 SELECT CAST(code AS INTEGER) AS actual, {filled} FROM range(4) t(code) LEFT JOIN rows_of ON label = code"""
    sql["classification_report"] = f"""WITH {PREDICTED}, classes AS (SELECT label AS c FROM predicted UNION SELECT prediction FROM predicted),
 sums AS (SELECT c, (SELECT count(*) FROM predicted WHERE label = c AND prediction = c) AS hit,
  (SELECT count(*) FROM predicted WHERE label = c) AS support, (SELECT count(*) FROM predicted WHERE prediction = c) AS called
  FROM classes),
 scored AS (SELECT c, support, CASE WHEN called > 0 THEN hit / called ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS recall,
  CASE WHEN called + support > 0 THEN 2 * hit / (called + support) ELSE 0.0 END AS f1 FROM sums),
 overall AS (SELECT CAST(sum(hit) AS DOUBLE) / sum(support) AS v, sum(support) AS support FROM sums),
 stacked AS (SELECT CAST(c AS VARCHAR) AS "row", precision, recall, f1, support FROM scored
  UNION ALL SELECT 'accuracy', v, v, v, support FROM overall
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scored
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
   sum(f1 * support) / sum(support), sum(support) FROM scored)
 SELECT "row", round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
  CAST(support AS BIGINT) AS support FROM stacked"""
    sql["exact_match"] = f"""WITH guesses AS (SELECT CASE WHEN doc_id % 4 = 0 THEN lower(text) ELSE {edged} END AS prediction,
 text AS target FROM documents) SELECT round(coalesce(avg(CASE WHEN {strip('prediction')} = {strip('target')} THEN 100.0
 ELSE 0.0 END), 0.0), 6) AS exact_match_pct FROM guesses"""
    sql["gate_threshold"] = """SELECT doc_id, least(n_chars / 5000.0, 1.0) AS probability, 1 AS is_buggy
 FROM documents WHERE n_chars / 5000.0 >= 0.3"""
    sql["gate_classes"] = f"WITH {LABELLED} SELECT doc_id, label, label <> 0 AS pass_on FROM labelled WHERE label <> 0"

    # ---- repair texts
    sql["repair_input"] = f"""WITH asked AS (SELECT conv_id, turn, text,
 CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE ' add nums ' END AS intent FROM conversations)
 SELECT conv_id, turn, md5(CASE WHEN intent <> '' THEN 'fix intent: ' || {strip('intent')} || ' code: ' || text
 ELSE 'fix: ' || text END) AS input_md5 FROM asked"""
    start, middle, end = (text(part) for part in REVIEW_PROMPT.split("%s"))
    sql["review_prompt"] = f"""SELECT conv_id, turn, md5({start} || text || {middle} || upper(role) || {end}) AS prompt_md5
 FROM conversations"""
    sql["coalesce_feedback"] = """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role WHEN turn % 3 = 0 THEN 'second' END
 AS feedback FROM conversations"""
    return sql
