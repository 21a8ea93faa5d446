"""Frameworks the audit knows: how each is recognised, what it owns or governs, and the rules it adds."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    """One framework. Order in PROFILES is evaluation order: the first match gives the attribution."""

    name: str
    about: str
    imports: tuple[str, ...]
    owns: tuple[str, ...] = ()
    #: function name and the leading parameter names that make a signature the framework's
    signatures: tuple[tuple[str, tuple[str, ...]], ...] = ()
    governs: tuple[str, ...] = ()
    auto_fix: bool = True
    secret_keys: tuple[str, ...] = ()
    secret_values: tuple[tuple[str, str], ...] = ()
    infra_keys: tuple[str, ...] = ()
    infra_values: tuple[tuple[str, str], ...] = field(default=())


def around(words: str) -> tuple[str, ...]:
    """Wildcards that find each of the words anywhere in a key."""
    return tuple(f"*{w}*" for w in words.split())


def _dotted(prefix: str, names: str) -> tuple[str, ...]:
    return tuple(f"{prefix}.{n}" for n in names.split())


JDBC = r"\bjdbc:[0-9a-z]+://[^\x22'\s]+"

PROFILES = (
    Profile("dbt", "Python models run by dbt, and the credentials in its profiles", ("dbt",), signatures=(("model", ("dbt", "session")),), secret_keys=around("client_secret private_key_passphrase")),
    Profile("polars", "Lake paths and storage credentials in Polars jobs", ("polars",), secret_keys=around("aws_secret azure_storage_key sas_token"), infra_keys=around("bucket sink_path source_path")),
    Profile("flink", "User functions and connector endpoints of PyFlink", ("pyflink",), owns=(*"udaf udf udtf".split(), *_dotted("pyflink.table", "udaf udf udtf")), secret_keys=around("sasl*password ssl*key*password"), infra_keys=around("bootstrap*servers checkpoint*dir jobmanager savepoint*path taskmanager"), infra_values=(("jdbc_url", JDBC),)),
    Profile("databricks", "Declarative tables, workspace addresses and access tokens of Databricks", ("databricks", "dlt", "pyspark"), owns=(*_dotted("dlt", "expect expect_all expect_or_drop expect_or_fail table view"), "pandas_udf", "table", "view"), secret_keys=around("databricks*token"), secret_values=(("databricks_pat", r"\bdapi[a-f0-9]{32}\b"),), infra_keys=around("catalog cluster_id instance_pool warehouse_id workspace_url"), infra_values=(("databricks_workspace_url", r"https://(?:adb-\d+\.\d+\.azuredatabricks\.net|[-0-9a-z]+\.cloud\.databricks\.com)"), ("databricks_cluster_id", r"\b\d{4}-\d{6}-[0-9a-z]{8}\b"), ("dbfs_path", r"\bdbfs:/[^\x22'\s]+"))),
    Profile("snowpark", "Registered functions and session settings of Snowpark", ("snowflake",), owns=(*"pandas_udf sproc udaf udf udtf".split(), *_dotted("snowflake.snowpark.functions", "sproc udf")), secret_keys=around("passphrase private_key"), infra_keys=around("account database role stage warehouse"), infra_values=(("snowflake_account_url", r"\b[0-9a-z][-._0-9a-z]*\.snowflakecomputing\.com"),)),
    Profile("airflow", "DAG and task functions, connection names and keys of Airflow", ("airflow",), owns=(*"asset dag dataset setup task_group teardown".split(), *_dotted("airflow.decorators", "dag task_group")), governs=("airflow.decorators.task", "task"), auto_fix=False, secret_keys=around("fernet_key smtp_password webserver_secret"), infra_keys=around("conn_id pool queue")),
)
NAMES = tuple(p.name for p in PROFILES)
