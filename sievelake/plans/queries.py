"""Queries over the driver's tables, and SQL that derives the same rows in closed form.

Rows of part and supplier are rendered to Python and YAML sources, which are parsed for real; documents,
conversations and pages are searched with value patterns of a contract of their own.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Contract, Infrastructure, Secrets, ValuePattern
from ..functions import text, wildcards
from ..operators import rules
from ..operators.parse import parse
from ..profiles import PROFILES
from ..sources.files import from_table, include
from . import forms
from .audit import Audit


def _k() -> Column:
    return F.col("k")


def _pick(by: int, *values) -> Column:
    """The value whose place is k modulo by; parts that are columns are joined as text."""
    out = None
    for n, v in enumerate(values):
        v = F.lit(v) if isinstance(v, str) else v
        out = F.when(_k() % by == n, v) if out is None else out.when(_k() % by == n, v)
    return out


def _with_key(prefix: str, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), _k().cast("string"), F.lit(suffix))


def _keys(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """A table's keys, spread over all cores: a few bytes of each row move, so that rendering and parsing, which take the time, don't stay where a small file put them."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("k")).repartition(spark.sparkContext.defaultParallelism)


def rendered_parts(spark: SparkSession, sf_dir: str, before: str = "") -> DataFrame:
    """A Python source for each part; every eleventh is broken."""
    rows = _keys(spark, sf_dir, "part", "p_partkey")
    head = F.when(_k() % 6 == 1, "from airflow.decorators import task\n").otherwise("import os\n")
    decorator = _pick(6, "@dag\n", "@airflow.decorators.task\n", "@udf\n", "", "@sievelake.task(retries=3)\n", "")
    name = _pick(5, _with_key("deploy_"), _with_key("run_"), _with_key("helper_"), _with_key("_deploy_"), _with_key("x", "_job"))
    params = _pick(4, "", 'target_environment: str = "dev"', "a, dry_run=False", "target_environment, dry_run")
    body = _pick(7, _with_key('api_password = "p4ss', '"'), 'token = "test"', 'api_key = "abcd"  # sievelake:allow-secret', _with_key('bucket = "prod-data-', '"'), _with_key('path = "s3://lake-', '/x"'), "return None", _with_key('db_secret_bucket = "zzz', '"'))
    good = F.concat(F.lit(before), head, decorator, F.lit("def "), name, F.lit("("), params, F.lit("):\n    "), body, F.lit("\n"))
    content = F.when(_k() % 11 == 0, 'def broken(:\n    token_x = "abcd"\n').otherwise(good)
    return rows.select(_with_key("jobs/p_", ".py").alias("path"), F.lit("python").alias("kind"), content.alias("content"), F.lit(None).cast("string").alias("read_error"))


_PARTS = """
WITH b AS (
  SELECT p_partkey AS k, 'jobs/p_' || p_partkey || '.py' AS path,
    CASE WHEN p_partkey % 6 IN (3, 5) THEN 2 ELSE 3 END AS def_line,
    CASE p_partkey % 5 WHEN 0 THEN 'deploy_' || p_partkey WHEN 1 THEN 'run_' || p_partkey WHEN 2 THEN 'helper_' || p_partkey WHEN 3 THEN '_deploy_' || p_partkey ELSE 'x' || p_partkey || '_job' END AS fn,
    p_partkey % 4 IN (1, 3) AS has_env, p_partkey % 4 IN (2, 3) AS has_dry, p_partkey % 11 = 0 AS broken,
    CASE WHEN p_partkey % 6 IN (0, 2) THEN 'exempt_framework' WHEN p_partkey % 5 = 3 THEN 'exempt_user' WHEN p_partkey % 5 = 2 AND p_partkey % 6 NOT IN (1, 4) THEN 'out_of_scope'
      WHEN p_partkey % 6 = 1 THEN 'governed_report_only' ELSE 'governed' END AS decision,
    CASE WHEN p_partkey % 6 = 1 THEN 'airflow' END AS governed_by, p_partkey % 7 AS body
  FROM part
), f AS (
  SELECT path, def_line AS line, 'KV001' AS code, 'error' AS severity, fn AS symbol, 'target_environment' AS subject, governed_by AS framework, 0 AS ord FROM b WHERE NOT broken AND decision LIKE 'governed%' AND NOT has_env
  UNION ALL SELECT path, def_line, 'KV001', 'warning', fn, 'dry_run', governed_by, 1 FROM b WHERE NOT broken AND decision LIKE 'governed%' AND NOT has_dry
  UNION ALL SELECT path, def_line + 1, 'KV002', 'error', CASE body WHEN 0 THEN 'api_password' ELSE 'db_secret_bucket' END, 'key_pattern', NULL, 2 FROM b WHERE NOT broken AND body IN (0, 6)
  UNION ALL SELECT path, def_line + 1, 'KV003', 'warning', 'bucket', 'key_pattern', NULL, 3 FROM b WHERE NOT broken AND body = 3
  UNION ALL SELECT path, def_line + 1, 'KV003', 'warning', '', 'object_store_uri', NULL, 4 FROM b WHERE NOT broken AND body = 4
), p AS (
  SELECT substr(sha256(path || chr(0) || code || chr(0) || symbol || chr(0) || subject), 1, 16) AS fingerprint, * FROM f
)
"""
_COLUMNS = ("fingerprint", "path", "line", "code", "severity", "symbol", "subject", "framework")
_P = ", ".join(_COLUMNS)


def _audit(spark: SparkSession, sf_dir: str, contract: Contract | None = None, before: str = "") -> Audit:
    return Audit(rendered_parts(spark, sf_dir, before), contract)


def _code(code: str, *more: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _audit(spark, sf_dir).findings().where(F.col("code") == code)
        for m in more:
            out = out.where(m)
        return out.select(*_COLUMNS)

    return query


def findings_union_ordered(spark, sf_dir):
    rows = _audit(spark, sf_dir).rows.select("path", F.posexplode_outer("findings").alias("place", "f")).where("f is not null")
    return rows.select("path", (F.col("place") + 1).alias("place"), "f.line", "f.code", "f.symbol", "f.subject")


def scope_tally(spark, sf_dir):
    return _audit(spark, sf_dir).summary().select("scope.*")


def kv001_scope_decision(spark, sf_dir):
    return _audit(spark, sf_dir).decisions()


def profile_activation(spark, sf_dir):
    return _audit(spark, sf_dir).rows.select("path", F.array_join("active", ",").alias("active"))


def frameworks_detected(spark, sf_dir):
    return _audit(spark, sf_dir).summary().select(F.explode("frameworks_detected").alias("framework", "files"))


def skipped_files(spark, sf_dir):
    return _audit(spark, sf_dir).skipped().drop("detail")


def _verdict(strict: bool, drift: bool = False):
    def query(spark, sf_dir):
        s = _audit(spark, sf_dir).summary(strict, "0" * 16 if drift else None)
        return s.select("files_scanned", "errors", "warnings", "skipped", "gating", "contract_drift", "verdict")

    return query


def _verdict_sql(strict: bool, drift: bool = False) -> str:
    gating = "errors + warnings + skipped" if strict else "errors"
    verdict = "3" if drift else f"CASE WHEN {gating} > 0 THEN 1 ELSE 0 END"
    return f"{_PARTS}, c AS (SELECT (SELECT count(*) FROM b) AS files_scanned, (SELECT count(*) FROM p WHERE severity = 'error') AS errors, (SELECT count(*) FROM p WHERE severity = 'warning') AS warnings, (SELECT count(*) FROM b WHERE broken) AS skipped) SELECT *, ({gating})::BIGINT AS gating, {str(drift).lower()} AS contract_drift, {verdict} AS verdict FROM c"


def fingerprint_line_shift(spark, sf_dir):
    """Lines of each finding without and with ten lines before it: the identity is the same."""
    one, two = (_audit(spark, sf_dir, before=b).findings().select("fingerprint", "path", F.col("line").alias(n)) for b, n in (("", "line"), ("\n" * 10, "shifted")))
    return one.join(two, ["fingerprint", "path"], "full")


def finding_messages(spark, sf_dir):
    return _audit(spark, sf_dir).findings().select("path", "line", "code", "subject", "kind", "message", "detail", "function", "parameter", "detector", "key")


_MESSAGES = """, v AS (
  SELECT p.*, b.k, b.body, CASE body WHEN 0 THEN 'p4ss' || k ELSE 'zzz' || k END AS secret FROM p JOIN b USING (path)
) SELECT path, line, code, subject, CASE code WHEN 'KV001' THEN 'missing_parameter' WHEN 'KV002' THEN 'hardcoded_secret' ELSE 'hardcoded_infrastructure' END AS kind,
  CASE WHEN code = 'KV001' THEN '`' || symbol || '` lacks the contract''s parameter `' || subject || '`' WHEN code = 'KV002' THEN '`' || symbol || '` is given a hardcoded literal'
    WHEN subject = 'key_pattern' THEN '`bucket` is pinned to `prod-data-' || k || '`' ELSE 'an identifier of one environment (object_store_uri)' END AS message,
  CASE WHEN subject = 'target_environment' THEN 'declare `target_environment: str = "dev"`' WHEN subject = 'dry_run' THEN 'declare `dry_run: bool = False`'
    WHEN code = 'KV002' THEN 'value ' || CASE WHEN length(secret) <= 4 THEN '<redacted:' || length(secret) || ' chars>' ELSE '"' || substr(secret, 1, 2) || '…" (<redacted>, ' || length(secret) || ' chars)' END || '; take it from the environment or a secret store'
    WHEN subject = 'key_pattern' THEN 'derive it from target_environment' ELSE '`s3://lake-' || k || '/x` should vary by environment' END AS detail,
  CASE WHEN code = 'KV001' THEN symbol END AS function, CASE WHEN code = 'KV001' THEN subject END AS parameter, CASE WHEN code <> 'KV001' THEN subject END AS detector, CASE WHEN code <> 'KV001' AND symbol <> '' THEN symbol END AS key FROM v"""


def module_roots(spark, sf_dir):
    name = F.col("p_brand")
    c = F.when(F.col("p_partkey") % 3 == 0, F.concat(name, F.lit(".x.y"))).when(F.col("p_partkey") % 3 == 1, name).otherwise(F.concat(F.lit("."), name))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.root_module(c).alias("root"))


def distinct_issues(spark, sf_dir):
    return _audit(spark, sf_dir).distinct_issues()


def fix_insert_params(spark, sf_dir):
    """The new signature line of each function that only lacks parameters."""
    done = _audit(spark, sf_dir).fixed().where(F.col("changed") & (F.size("secrets_externalized") == 0))
    return done.select("path", F.regexp_extract("new_source", r"(?m)^def .*$", 0).alias("signature"))


def fix_externalize_secrets(spark, sf_dir):
    return _audit(spark, sf_dir).fixed().select("path", F.explode("secrets_externalized").alias("s"), "new_source").select("path", "s.key", "s.env", F.regexp_extract("new_source", r"(?m)^    .*$", 0).alias("line"))


def fix_add_import(spark, sf_dir):
    """First lines of rewritten sources that needed ``import os``: those that didn't have it."""
    done = _audit(spark, sf_dir).fixed().where(F.size("secrets_externalized") > 0)
    return done.select("path", F.split("new_source", "\n")[0].alias("first"), (F.size(F.split("new_source", r"(?m)^import os$")) - 1).alias("imports"))


def fix_manual_items(spark, sf_dir):
    done = _audit(spark, sf_dir).fixed().select("path", F.explode("manual").alias("m")).select("path", "m.line", "m.reason")
    kind = F.when(F.col("reason").contains("syntax errors"), "syntax").when(F.col("reason").contains("by hand"), "by_hand").otherwise("other")
    return done.select("path", F.coalesce("line", F.lit(0)).alias("line"), kind.alias("reason"))


def fix_then_audit_clean(spark, sf_dir):
    """What an audit of the rewritten sources still finds: pinned infrastructure, and parameters that only a person can add."""
    done = _audit(spark, sf_dir).fixed().where("changed")
    again = Audit(done.select("path", F.lit("python").alias("kind"), F.col("new_source").alias("content"), F.lit(None).cast("string").alias("read_error")))
    return again.findings().select("path", "code", "symbol", "subject")


def rendered_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keys(spark, sf_dir, "supplier", "s_suppkey")
    password = _pick(3, _with_key('"pw-', '"'), "'{{ env_var(\"X\") }}'", "${PW}")
    content = F.concat(F.lit("target: dev\npassword: "), password, _with_key("\nnotes: |\n  password: hidden\n\n  more\napi_token: tok-", "  # rotate\nurl: https://x/#y\nitems:\n  - secret_key: 's"), _k().cast("string"), F.lit("'\n  - plain\n"))
    return rows.select(_with_key("conf/s_", ".yml").alias("path"), F.lit("yaml").alias("kind"), content.alias("content"), F.lit(None).cast("string").alias("read_error"))


def yaml_scalars(spark, sf_dir):
    return parse(rendered_yaml(spark, sf_dir)).select("path", F.explode("scalars").alias("s")).select("path", "s.key", "s.value", "s.line")


def yaml_secrets(spark, sf_dir):
    return Audit(rendered_yaml(spark, sf_dir)).findings().select(*_COLUMNS)


_YAML = """
WITH s AS (
  SELECT s_suppkey AS k, 'conf/s_' || s_suppkey || '.yml' AS path, CASE s_suppkey % 3 WHEN 0 THEN 'pw-' || s_suppkey WHEN 1 THEN '{{ env_var("X") }}' ELSE '${PW}' END AS pw FROM supplier
), y AS (
  SELECT path, k, 'target' AS key, 'dev' AS value, 1 AS line FROM s UNION ALL SELECT path, k, 'password', pw, 2 FROM s UNION ALL SELECT path, k, 'api_token', 'tok-' || k, 7 FROM s
  UNION ALL SELECT path, k, 'url', 'https://x/#y', 8 FROM s UNION ALL SELECT path, k, 'secret_key', 's' || k, 10 FROM s
)
"""
_YAML_SECRETS = _YAML + """
SELECT substr(sha256(path || chr(0) || 'KV002' || chr(0) || key || chr(0) || 'key_pattern'), 1, 16) AS fingerprint, path, line, 'KV002' AS code, 'error' AS severity, key AS symbol, 'key_pattern' AS subject, NULL::VARCHAR AS framework
FROM y WHERE key IN ('password', 'api_token', 'secret_key') AND value NOT LIKE '%{{%' AND value NOT LIKE '%${%' AND length(value) >= 4
"""

#: patterns of a corpus contract: names, expressions
CORPUS = (("hex_token", r'token = "[0-9a-f]{40}"'), ("any_token", "token = "), ("card", "[0-9]{16}"), ("address", r"[0-9a-z.]+@[0-9a-z.]+\.[a-z]+"))


def _corpus(table: str, key: str, column: str = "text", patterns=CORPUS):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, column)
        hits = rules.value_hits(F.col(column), F.array().cast("array<string>"), [(None, n, r) for n, r in patterns], "sievelake:allow-secret")
        return rows.select(key, F.explode_outer(hits).alias("h")).where("h is not null").select(key, "h.line", "h.detector", "h.found")

    return query


def _corpus_sql(table: str, key: str, column: str = "text", patterns=CORPUS) -> str:
    cases = " ".join(f"WHEN regexp_matches(line_text, '{r}') THEN '{n}'" for n, r in patterns)
    found = " ".join(f"WHEN regexp_matches(line_text, '{r}') THEN regexp_extract(line_text, '{r}')" for _, r in patterns)
    return f"WITH l AS (SELECT {key}, unnest(string_split({column}, chr(10))) AS line_text, generate_subscripts(string_split({column}, chr(10)), 1) AS line FROM {table}) SELECT {key}, line::INT AS line, CASE {cases} END AS detector, CASE {found} END AS found FROM l WHERE CASE {cases} END IS NOT NULL"


URLS = (("plain_http", r"http://[^ ]+"), ("page_query", r"[?]page=[0-9]+"))


def corpus_audit(spark, sf_dir):
    """Documents as sources of their own under a corpus contract: only its value patterns."""
    none = replace(Secrets(), key_patterns=(), value_patterns=tuple(ValuePattern(n, r) for n, r in CORPUS))
    contract = Contract(parameters=(), secrets=none, infrastructure=replace(Infrastructure(), enabled=False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("corpus/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return Audit(from_table(docs, "path", "text"), contract).findings().groupBy("subject").agg(F.count("*").alias("findings"), F.countDistinct("path").alias("files"))


def wildcard_keys(spark, sf_dir):
    name = F.col("p_name")
    return spark.read.parquet(f"{sf_dir}/part.parquet").where(wildcards.any_of(name, ["*a?e*", "p*1", "*_x*"])).select("p_partkey", "p_name")


def path_glob_filter(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    path = F.concat(_pick(4, "", "src/", "build/", "a/.venv/lib/"), _k().cast("string"), _pick(3, ".py", ".yml", ".txt"))
    return include(rows.select(path.alias("path")), Contract())


def text_functions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    c = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return rows.select("p_partkey", text.redact(c).alias("redacted"), text.truncate(F.concat_ws(" / ", c, c)).alias("truncated"), text.env_var_name(F.col("p_brand"), "X_").alias("env"), text.last_segment(F.concat_ws(".", F.lit("a"), F.col("p_brand"))).alias("segment"), text.ascii_lower(F.col("p_type")).alias("lower"), text.fingerprint(F.col("p_name"), F.lit("KV001"), F.col("p_brand"), F.col("p_type")).alias("fingerprint"), text.render_param(F.col("p_brand"), F.when(F.col("p_size") > 25, "int"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))).alias("param"))


def rfc3339_format(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.rfc3339(F.col("o_orderdate")).alias("at"))


def profile_catalog(spark, sf_dir):
    rows = [(n, p.name, ",".join(p.imports), len(p.owns), len(p.secret_keys), len(p.secret_values), len(p.infra_keys), len(p.infra_values), p.auto_fix) for n, p in enumerate(PROFILES)]
    return spark.createDataFrame(rows, "place int, profile string, imports string, owns int, secret_keys int, secret_values int, infra_keys int, infra_values int, auto_fix boolean")


def line_index(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).select("doc_id", (F.col("line") + 1).alias("line"), F.char_length("s").alias("chars"))


_SIGNATURE = """CASE k % 4 WHEN 0 THEN 'target_environment: str = "dev", dry_run: bool = False' WHEN 1 THEN 'target_environment: str = "dev", dry_run: bool = False' WHEN 2 THEN 'a, dry_run=False, target_environment: str = "dev"' ELSE 'target_environment, dry_run' END"""
_LACKS = "NOT broken AND decision = 'governed' AND NOT (has_env AND has_dry)"

#: name -> (query, SQL)
ALL = {
    "kv001_missing_params": (_code("KV001"), f"{_PARTS} SELECT {_P} FROM p WHERE code = 'KV001'"),
    "kv002_key_rule": (_code("KV002"), f"{_PARTS} SELECT {_P} FROM p WHERE code = 'KV002'"),
    "kv003_key_rule": (_code("KV003", "subject = 'key_pattern'"), f"{_PARTS} SELECT {_P} FROM p WHERE code = 'KV003' AND subject = 'key_pattern'"),
    "kv003_value_rule": (_code("KV003", "subject <> 'key_pattern'"), f"{_PARTS} SELECT {_P} FROM p WHERE code = 'KV003' AND subject <> 'key_pattern'"),
    "findings_union_ordered": (findings_union_ordered, f"{_PARTS} SELECT path, row_number() OVER (PARTITION BY path ORDER BY line, code, ord)::INT AS place, line, code, symbol, subject FROM p"),
    "kv001_scope_decision": (kv001_scope_decision, f"{_PARTS} SELECT path, fn AS function, def_line AS line, decision, governed_by FROM b WHERE NOT broken"),
    "scope_tally": (scope_tally, f"{_PARTS} SELECT count(*) AS functions_total, count_if(decision LIKE 'governed%')::BIGINT AS functions_in_scope, count_if(decision = 'governed_report_only')::BIGINT AS functions_report_only, count_if(decision = 'exempt_framework')::BIGINT AS functions_exempt_framework, count_if(decision = 'exempt_user')::BIGINT AS functions_exempt_user, count_if(decision = 'out_of_scope')::BIGINT AS functions_out_of_scope FROM b WHERE NOT broken"),
    "profile_activation": (profile_activation, f"{_PARTS} SELECT path, CASE WHEN broken THEN '' WHEN k % 6 IN (0, 1) THEN 'airflow' WHEN k % 6 = 2 THEN 'flink,snowpark' ELSE '' END AS active FROM b"),
    "frameworks_detected": (frameworks_detected, f"{_PARTS}, d AS (SELECT unnest(CASE WHEN k % 6 IN (0, 1) THEN ['airflow'] WHEN k % 6 = 2 THEN ['flink', 'snowpark'] ELSE [] END) AS framework FROM b WHERE NOT broken) SELECT framework, count(*) AS files FROM d GROUP BY 1"),
    "skipped_files": (skipped_files, f"{_PARTS} SELECT path, 'syntax_error' AS reason, 'warning' AS severity FROM b WHERE broken"),
    "gating_lenient": (_verdict(False), _verdict_sql(False)),
    "gating_strict": (_verdict(True), _verdict_sql(True)),
    "run_verdict_drift": (_verdict(False, True), _verdict_sql(False, True)),
    "fingerprint_line_shift": (fingerprint_line_shift, f"{_PARTS} SELECT fingerprint, path, line, line + 10 AS shifted FROM p"),
    "distinct_issues": (distinct_issues, f"{_PARTS} SELECT fingerprint, path, code, symbol, subject, count(*) AS occurrences, min(line) AS first_line FROM p GROUP BY ALL"),
    "finding_messages": (finding_messages, f"{_PARTS}{_MESSAGES}"),
    "module_roots": (module_roots, "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS root FROM part"),
    "fix_insert_params": (fix_insert_params, f"{_PARTS} SELECT path, 'def ' || fn || '(' || {_SIGNATURE} || '):' AS signature FROM b WHERE {_LACKS} AND body NOT IN (0, 6)"),
    "fix_externalize_secrets": (fix_externalize_secrets, f"""{_PARTS}, s AS (SELECT *, CASE body WHEN 0 THEN 'api_password' ELSE 'db_secret_bucket' END AS key FROM b WHERE NOT broken AND body IN (0, 6)) SELECT path, key, upper(key) AS env, '    ' || key || ' = os.environ["' || upper(key) || '"]' AS line FROM s"""),
    "fix_add_import": (fix_add_import, f"{_PARTS} SELECT path, 'import os' AS first, 1 AS imports FROM b WHERE NOT broken AND body IN (0, 6)"),
    "fix_manual_items": (fix_manual_items, f"{_PARTS} SELECT path, 0 AS line, 'syntax' AS reason FROM b WHERE broken UNION ALL SELECT path, def_line, 'by_hand' FROM b WHERE NOT broken AND decision = 'governed_report_only' AND NOT (has_env AND has_dry)"),
    "fix_then_audit_clean": (fix_then_audit_clean, f"{_PARTS} SELECT path, code, symbol, subject FROM p JOIN b USING (path) WHERE (body IN (0, 6) OR decision = 'governed' AND NOT (has_env AND has_dry)) AND (code = 'KV003' OR framework IS NOT NULL)"),
    "yaml_scalars": (yaml_scalars, f"{_YAML} SELECT path, key, value, line FROM y"),
    "yaml_secrets": (yaml_secrets, _YAML_SECRETS),
    "kv002_value_rule_documents": (_corpus("documents", "doc_id"), _corpus_sql("documents", "doc_id")),
    "kv002_value_rule_conversations": (_corpus("conversations", "conv_id"), _corpus_sql("conversations", "conv_id")),
    "value_rule_page_urls": (_corpus("pages", "page_id", "url", URLS), _corpus_sql("pages", "page_id", "url", URLS)),
    "corpus_audit": (corpus_audit, f"WITH h AS ({_corpus_sql('documents', 'doc_id')}) SELECT detector AS subject, count(*) AS findings, count(DISTINCT doc_id) AS files FROM h GROUP BY 1"),
    "wildcard_keys": (wildcard_keys, r"SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%' OR p_name LIKE 'p%1' OR p_name LIKE '%\_x%' ESCAPE '\'"),
    "path_glob_filter": (path_glob_filter, "SELECT CASE WHEN p_partkey % 4 = 1 THEN 'src/' ELSE '' END || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.py' ELSE '.yml' END AS path FROM part WHERE p_partkey % 4 IN (0, 1) AND p_partkey % 3 IN (0, 1)"),
    "text_functions": (text_functions, r"""WITH c AS (SELECT *, trim(p_name || ' ' || p_type || ' ' || p_brand) AS c FROM part)
        SELECT p_partkey, '"' || substr(c, 1, 2) || '…" (<redacted>, ' || length(c) || ' chars)' AS redacted, CASE WHEN length(c || ' / ' || c) > 48 THEN substr(c || ' / ' || c, 1, 45) || '...' ELSE c || ' / ' || c END AS truncated,
        'X_' || regexp_replace(upper(regexp_replace(p_brand, '[^0-9A-Za-z]', '_', 'g')), '^_+|_+$', '', 'g') AS env, p_brand AS segment, lower(p_type) AS lower, substr(sha256(p_name || chr(0) || 'KV001' || chr(0) || p_brand || chr(0) || p_type), 1, 16) AS fingerprint,
        p_brand || CASE WHEN p_size > 25 THEN ': int' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size > 25 THEN ' = ' ELSE '=' END || p_size ELSE '' END AS param FROM c"""),
    "rfc3339_format": (rfc3339_format, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders"),
    "line_index": (line_index, "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line, length(unnest(string_split(text, chr(10))))::INT AS chars FROM documents"),
    "profile_catalog": (profile_catalog, "SELECT * FROM (VALUES (0, 'dbt', 'dbt', 0, 2, 0, 0, 0, true), (1, 'polars', 'polars', 0, 3, 0, 3, 0, true), (2, 'flink', 'pyflink', 6, 2, 0, 5, 1, true), (3, 'databricks', 'databricks,dlt,pyspark', 9, 1, 1, 5, 3, true), (4, 'snowpark', 'snowflake', 7, 2, 0, 5, 1, true), (5, 'airflow', 'airflow', 8, 3, 0, 3, 0, false)) AS t(place, profile, imports, owns, secret_keys, secret_values, infra_keys, infra_values, auto_fix)"),
}
ALL |= forms.ALL
QUERIES = {name: query for name, (query, _) in ALL.items()}
ORACLES = {name: sql for name, (_, sql) in ALL.items()}
