"""The parse stage: sources to one analysed row each. The only Python stage of an audit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..schemas import ANALYSIS
from .parse_python import analyze
from .parse_yaml import scalars

_NONE = {"has_error": False, "functions": [], "bindings": [], "modules": [], "binds_os": False, "first_import": None, "after_prelude": 0, "scalars": []}
_ROWS = 256


def parse(sources: DataFrame) -> DataFrame:
    """One row for each source, as schemas.ANALYSIS has it. Narrow: no shuffle."""
    kind = _parse_datatype_string(ANALYSIS)
    assert isinstance(kind, StructType)
    schema = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                rows = []
                for r in batch.slice(at, _ROWS).to_pylist():
                    text = r["content"]
                    found = _NONE if text is None else _NONE | ({"scalars": scalars(text)} if r["kind"] == "yaml" else analyze(text))
                    rows.append(r | found)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sources.select("path", "kind", "content", "read_error").mapInArrow(run, kind)
