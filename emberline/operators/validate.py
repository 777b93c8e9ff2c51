"""Row validation: one projection that turns raw cells into typed log columns plus an error list.

The projection is shared by every source and by the streaming ingest. A source hands over one ``Cell``
per field; text sources use plain string columns, JSON sources use VARIANT values so that a JSON number
in a string field can be told from a string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import fields as fx
from emberline.schema import (
    ERROR_CHARS, EVENT_TYPES, IP_FIELDS, KNOWN_FIELDS, NESTED_FIELDS, NESTED_NUMBER, NESTED_TEXT,
    OPTIONAL_TEXT, PORT_FIELDS, PREVIEW_CHARS, REQUIRED_TEXT, SEVERITIES,
)


@dataclass(frozen=True)
class Cell:
    """SQL text over the columns of one raw field: its text, its number, and whether it holds anything else."""

    name: str
    typed: bool

    @property
    def text(self) -> str:
        return f"_t_{self.name}"

    @property
    def number(self) -> str:
        return f"_n_{self.name}" if self.typed else "cast(null AS DOUBLE)"

    @property
    def present(self) -> str:
        found = f"_t_{self.name} IS NOT NULL"
        return f"({found} OR _n_{self.name} IS NOT NULL OR _o_{self.name})" if self.typed else f"({found})"

    @property
    def not_text(self) -> str:
        return f"({self.present} AND {self.text} IS NULL)"


def _typed_cells(df: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Add text, number and other-kind columns per field; each VARIANT path is read and typed once."""
    got = df.selectExpr("*", *[f"{value} AS _v_{n}" for n, value in sources.items()])
    kinds = got.selectExpr("*", *[f"schema_of_variant(_v_{n}) AS _k_{n}" for n in sources])
    cells = []
    for n in sources:
        cells += [
            f"CASE WHEN _k_{n} = 'STRING' THEN try_variant_get(_v_{n}, '$', 'string') END AS _t_{n}",
            f"CASE WHEN _k_{n} = 'BOOLEAN' THEN cast(try_variant_get(_v_{n}, '$', 'boolean') AS DOUBLE) "
            f"WHEN _k_{n} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith(_k_{n}, 'DECIMAL') "
            f"THEN try_variant_get(_v_{n}, '$', 'double') END AS _n_{n}",
            f"coalesce(startswith(_k_{n}, 'OBJECT') OR startswith(_k_{n}, 'ARRAY'), false) AS _o_{n}",
        ]
    return kinds.selectExpr(*[f"`{c}`" for c in df.columns], *cells)


def _problem(bad: str, field: str, message: str) -> str:
    return f"CASE WHEN {bad} THEN named_struct('field', '{field}', 'msg', '{message}') END"


def map_extras(fields: str, known: list[str]) -> str:
    """Keys of a VARIANT map outside ``known`` as text: strings as they are, anything else as JSON."""
    unknown = f"map_filter({fields}, (k, v) -> k NOT IN ({fx.quoted(known)}))"
    as_text = "CASE WHEN schema_of_variant(v) = 'STRING' THEN try_variant_get(v, '$', 'string') ELSE to_json(v) END"
    return f"coalesce(transform_values({unknown}, (k, v) -> {as_text}), cast(map() AS MAP<STRING, STRING>))"


def _validated(cells: DataFrame, typed: bool) -> DataFrame:
    """Values first, then the checks over cells and values, as two projections.

    Input columns: the cells of every known field, one VARIANT ``_nested_<name>`` per sub-object
    (null when absent), ``_extras`` and ``_preview``.
    """

    def cell(name: str) -> Cell:
        return Cell(name, typed)

    def child_cell(name: str, child: str) -> Cell:
        return Cell(f"{name}__{child}", True)

    values = {name: cell(name).text for name in [*REQUIRED_TEXT, *OPTIONAL_TEXT]}
    values["timestamp"] = fx.time_from_text(cell("timestamp").text)
    values["event_type"] = fx.enum_member(cell("event_type").text, EVENT_TYPES)
    values["severity"] = fx.enum_member(cell("severity").text, SEVERITIES)
    for name in IP_FIELDS:
        values[name] = fx.ip_text(cell(name).text)
    for name in PORT_FIELDS:
        values[name] = fx.port_from_text(cell(name).text)
    if typed:
        of_number = {
            "timestamp": fx.time_from_number,
            **dict.fromkeys(IP_FIELDS, fx.ipv4_from_number),
            **dict.fromkeys(PORT_FIELDS, fx.port_from_number),
        }
        for name, convert in of_number.items():
            values[name] = f"coalesce(({values[name]}), ({convert(cell(name).number)}))"

    children = {name: [*NESTED_TEXT[name], *NESTED_NUMBER[name]] for name in NESTED_FIELDS}
    replaced = {f"_t_{name}": fx.blank_marker_to_null(f"_t_{name}") for name in [*IP_FIELDS, *PORT_FIELDS]}
    cells = cells.selectExpr(
        *[f"{replaced[c]} AS {c}" if c in replaced else f"`{c}`" for c in cells.columns],
        # A sub-object is opened once, as a map; anything else than an object gives null here.
        *[f"try_variant_get(_nested_{name}, '$', 'map<string,variant>') AS _map_{name}" for name in NESTED_FIELDS],
    )
    cells = cells.selectExpr(
        "*", *[f"{map_extras(f'_map_{name}', children[name])} AS _extras_{name}" for name in NESTED_FIELDS]
    )
    sources = {f"{name}__{child}": f"_map_{name}['{child}']" for name in NESTED_FIELDS for child in children[name]}
    cells = _typed_cells(cells, sources)
    for name in NESTED_FIELDS:
        for child in NESTED_NUMBER[name]:
            c = child_cell(name, child)
            values[c.name] = f"coalesce({c.number}, try_cast({fx.strip(c.text)} AS DOUBLE))"

    staged = cells.selectExpr("*", *[f"{sql} AS _x_{name}" for name, sql in values.items()])

    problems: list[str] = []
    for name in REQUIRED_TEXT:
        problems.append(_problem(f"NOT {cell(name).present}", name, "field required"))
        if typed:
            problems.append(_problem(cell(name).not_text, name, "not a string"))
    problems.append(_problem("length(_t_description) < 1", "description", "empty"))
    for name, message in (("timestamp", "not a time"), ("event_type", "not a known value")):
        problems.append(_problem(f"NOT {cell(name).present}", name, "field required"))
        problems.append(_problem(f"{cell(name).present} AND _x_{name} IS NULL", name, message))
    problems.append(_problem(f"{cell('severity').present} AND _x_severity IS NULL", "severity", "not a known value"))
    for name in NESTED_FIELDS:
        problems.append(_problem(f"_nested_{name} IS NOT NULL AND _map_{name} IS NULL", name, "not an object"))
        for child in NESTED_TEXT[name]:
            problems.append(_problem(child_cell(name, child).not_text, f"{name}.{child}", "not a string"))
        for child in NESTED_NUMBER[name]:
            c = child_cell(name, child)
            problems.append(_problem(f"{c.present} AND _x_{c.name} IS NULL", f"{name}.{child}", "not a number"))
    if typed:
        problems += [_problem(cell(name).not_text, name, "not a string") for name in OPTIONAL_TEXT]
    for name in [*IP_FIELDS, *PORT_FIELDS]:
        message = "not an address" if name in IP_FIELDS else "not a port"
        problems.append(_problem(f"{cell(name).present} AND _x_{name} IS NULL", name, message))

    def nested_struct(name: str) -> str:
        texts = [f"'{child}', {child_cell(name, child).text}" for child in NESTED_TEXT[name]]
        numbers = [f"'{child}', _x_{name}__{child}" for child in NESTED_NUMBER[name]]
        return f"named_struct({', '.join([*texts, *numbers])}, 'extras', _extras_{name}) AS {name}"

    return staged.selectExpr(
        *[c for c in POSITION if c in staged.columns],
        *[f"_x_{name} AS `{name}`" for name in [*REQUIRED_TEXT, "timestamp", "event_type", "severity"]],
        *[nested_struct(name) for name in NESTED_FIELDS],
        *[f"_x_{name} AS `{name}`" for name in [*OPTIONAL_TEXT, *IP_FIELDS, *PORT_FIELDS]],
        "_extras AS extras",
        # The partition id is never negative. Naming it keeps a filter on ``errors`` above this projection:
        # pushed below, the whole check list would be inlined and every cell computed several times per row.
        f"CASE WHEN spark_partition_id() >= 0 THEN array_compact(array({', '.join(problems)})) END AS errors",
        f"left(_preview, {PREVIEW_CHARS}) AS raw_preview",
    )


POSITION = ("log_idx", "row_no", "source_file")
_SCALARS = [name for name in KNOWN_FIELDS if name not in NESTED_FIELDS]


def validate_text(df: DataFrame) -> DataFrame:
    """Validate rows whose fields are string columns (CSV); empty cells are absent, unknown columns extras."""
    given = [c for c in df.columns if c not in POSITION]

    def raw(name: str) -> str:
        return f"nullif(`{name}`, '')" if name in given else "cast(null AS STRING)"

    def nested(name: str) -> str:
        text = fx.strip(raw(name))
        return f"coalesce(CASE WHEN startswith({text}, '{{') THEN try_parse_json({text}) END, cast({raw(name)} AS VARIANT))"

    pairs = [f"named_struct('key', '{c}', 'value', {raw(c)})" for c in given if c not in KNOWN_FIELDS]
    extras = "cast(map() AS MAP<STRING, STRING>)"
    if pairs:
        extras = f"map_from_entries(filter(array({', '.join(pairs)}), e -> e.value IS NOT NULL))"
    cells = df.selectExpr(
        *[c for c in POSITION if c in df.columns],
        *[f"{raw(name)} AS `_t_{name}`" for name in _SCALARS],
        *[f"{nested(name)} AS _nested_{name}" for name in NESTED_FIELDS],
        f"{extras} AS _extras",
        f"to_json(struct({', '.join(f'{raw(c)} AS `{c}`' for c in given)})) AS _preview",
    )
    return _validated(cells, typed=False)


def validate_variant(df: DataFrame, column: str = "row") -> DataFrame:
    """Validate rows held as one VARIANT object per row (JSON, JSON lines)."""
    whole = f"try_variant_get({column}, '$', 'map<string,variant>')"
    with_parts = df.selectExpr(
        *[c for c in POSITION if c in df.columns],
        f"{column} AS _row",
        *[f"variant_get({column}, '$.{name}', 'variant') AS _nested_{name}" for name in NESTED_FIELDS],
        f"{map_extras(whole, KNOWN_FIELDS)} AS _extras",
        f"to_json({column}) AS _preview",
    )
    return _validated(_typed_cells(with_parts, {name: f"variant_get(_row, '$.{name}', 'variant')" for name in _SCALARS}), typed=True)


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") == 0).drop("errors", "raw_preview")


def rejected_rows(validated: DataFrame) -> DataFrame:
    """(row_no, error, raw_preview) of the rows that failed."""
    told = F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["msg"])), "; ")
    keep = [c for c in ("log_idx", "row_no", "source_file") if c in validated.columns]
    return validated.filter(F.size("errors") > 0).select(
        *keep, F.left(told, F.lit(ERROR_CHARS)).alias("error"), "raw_preview"
    )


def load_stats(validated: DataFrame) -> DataFrame:
    """One row: total, parsed, skipped and skip rate (0 on empty input)."""
    bad = F.size("errors") > 0
    return validated.agg(
        F.count("*").alias("total_rows"),
        F.count_if(~bad).alias("parsed"),
        F.count_if(bad).alias("skipped"),
    ).withColumn("skip_rate", F.coalesce(F.try_divide(F.col("skipped"), F.col("total_rows")), F.lit(0.0)))


def require_valid(validated: DataFrame) -> DataFrame:
    """Strict mode: raise on the first rejected row found, else hand back the valid rows."""
    first = rejected_rows(validated).limit(1).collect()
    if first:
        raise ValueError(f"invalid log row: {first[0]['error']}")
    return valid_rows(validated)


def split_by_text_limit(df: DataFrame, column: str, limit: int, mode: str = "quarantine") -> DataFrame:
    """Guard scorer input: cut over-long texts, or flag them for a quarantine table."""
    over = F.length(column) > limit
    if mode == "truncate":
        return df.withColumn(column, F.left(F.col(column), F.lit(limit))).withColumn("over_limit", over)
    if mode != "quarantine":
        raise ValueError(f"mode must be 'quarantine' or 'truncate', got {mode!r}")
    return df.withColumn("over_limit", over)
