"""Dataset contracts as data, and the checks they imply."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.keys import SENSITIVE_NAME_PATTERN
from tidelake.functions.scalar import to_number
from tidelake.operators import quality as Q
from tidelake.session import small_table

# Literals a boolean contract column accepts.
BOOLEAN_LITERALS = ("true", "false", "1", "0", "yes", "no")

# Fields every contract document states, and its compatibility flags.
REQUIRED_FIELDS = [
    "dataset",
    "version",
    "owner",
    "classification",
    "grain",
    "freshness_slo_hours",
    "allowed_destinations",
    "primary_key",
    "columns",
    "compatibility",
]
COMPATIBILITY_FLAGS = [
    "allow_add_optional_column",
    "allow_remove_required_column",
    "allow_type_change_required_column",
]

# Columns that may not appear in a public dataset, by exact name ...
FORBIDDEN_PUBLIC_COLUMNS = [
    "customer_id",
    "customer_unique_id",
    "order_id",
    "product_id",
    "seller_id",
    "review_id",
    "synthetic_email",
    "synthetic_phone",
    "marketing_consent",
    "customer_zip_code_prefix",
    "seller_zip_code_prefix",
    "address",
]
# ... and by a part of the name.
FORBIDDEN_PUBLIC_PARTS = [
    "customer_id",
    "customer_unique_id",
    "order_id",
    "product_id",
    "seller_id",
    "review_id",
    "email",
    "phone",
    "address",
    "zip_code",
    "postal",
    "consent",
]


@dataclass(frozen=True)
class ContractColumn:
    name: str
    type: str
    required: bool = True
    pii: bool = False


@dataclass(frozen=True)
class Contract:
    dataset: str
    version: str
    owner: str
    classification: str
    grain: str
    freshness_slo_hours: float | None
    allowed_destinations: list[str]
    primary_key: list[str]
    columns: list[ContractColumn]
    compatibility: dict[str, bool]
    forbidden_destinations: list[str] = field(default_factory=list)
    forbidden_fields: list[str] = field(default_factory=list)

    @staticmethod
    def from_mapping(document: dict) -> Contract:
        """Contract from a parsed document; absent parts stay empty and fail their checks."""
        known = {f.name for f in fields(Contract)} - {"columns"}
        empty = {"freshness_slo_hours": None, "compatibility": {}}
        lists = ("allowed_destinations", "primary_key", "forbidden_destinations", "forbidden_fields")
        values = {name: document.get(name) or empty.get(name, "") for name in known}
        values.update({name: list(document.get(name) or []) for name in lists})
        columns = [
            ContractColumn(name, str(rule.get("type", "")).lower(),
                           bool(rule.get("required")), bool(rule.get("pii")))
            for name, rule in (document.get("columns") or {}).items()
        ]
        return Contract(columns=columns, **values)


def contracts_table(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    """One row per contract column: small, read from the contract documents."""
    rows = [
        (
            c.dataset, c.version, c.owner, c.classification, c.grain, c.freshness_slo_hours,
            c.allowed_destinations, c.forbidden_destinations, c.primary_key, position,
            column.name, column.type, column.required, column.pii, c.forbidden_fields,
        )
        for c in contracts
        for position, column in enumerate(c.columns, start=1)
    ]
    return small_table(
        spark,
        rows,
        "dataset string, version string, owner string, classification string, grain string,"
        " freshness_slo_hours double, allowed_destinations array<string>,"
        " forbidden_destinations array<string>, primary_key array<string>, position int,"
        " column_name string, declared_type string, required boolean, pii boolean,"
        " forbidden_fields array<string>",
    )


# Types of columns whose cells are of a declared type by themselves.
BY_TYPE = {
    "string": ("string",),
    "integer": ("tinyint", "smallint", "int", "bigint"),
    "decimal": ("tinyint", "smallint", "int", "bigint"),
    "date": ("date",),
    "boolean": ("boolean",),
}


def type_violation(column: str, declared: str, dtype: str = "") -> Column:
    """True for a non-NULL value that is not of the declared type; unknown type: always.

    Where the column's own type ``dtype`` is given, only what it leaves open is looked at.
    """
    value = F.col(column)
    if dtype in BY_TYPE.get(declared, ()):
        return F.lit(False)
    if dtype in ("double", "float") and declared in ("integer", "decimal"):
        finite = F.abs(value) < F.lit(float("inf"))
        return ~F.coalesce(finite & (value % 1 == 0 if declared == "integer" else finite), value.isNull())
    text = value.cast("string")
    number = to_number(text, "double")
    tests = {
        "string": F.typeof(value) != "string",
        "integer": number.isNull() | (number % 1 != 0),
        "decimal": number.isNull(),
        "date": F.try_to_date(text, "yyyy-MM-dd").isNull(),
        "boolean": ~F.lower(text).isin(*BOOLEAN_LITERALS),
    }
    return value.isNotNull() & F.coalesce(tests.get(declared, F.lit(True)), F.lit(True))


def value_checks(contract: Contract, types: dict[str, str]) -> list[Q.Check]:
    """Type and required-value counters of the declared columns; ``types`` are those present."""
    checks = []
    for column in contract.columns:
        if column.name not in types:
            continue
        nulls = F.count_if(F.col(column.name).isNull())
        not_null = f"{column.name}_required_not_null"
        if column.required:
            checks.append(Q.Check(not_null, nulls))
        else:
            checks.append(Q.Check(not_null, nulls, "nullable", "true"))
        checks.append(
            Q.violations(
                f"{column.name}_type_{column.type}",
                type_violation(column.name, column.type, types[column.name]),
            )
        )
    return checks


def column_checks(contract: Contract, present: list[str]) -> list[tuple]:
    """Declared columns missing, additions and order; an addition may be allowed."""
    declared = [c.name for c in contract.columns]
    missing = [c for c in declared if c not in present]
    added = [c for c in present if c not in declared]
    allowed = bool(contract.compatibility.get("allow_add_optional_column", False))
    in_order = [c for c in present if c in declared]
    return [
        ("all_declared_columns_present", not missing, Q.listed(missing), "none missing", ""),
        (
            "unexpected_columns_compatible",
            not added or allowed,
            Q.listed(added),
            "allowed" if allowed else "none",
            "",
        ),
        (
            "declared_column_order_matches",
            in_order == declared,
            Q.listed(in_order),
            Q.listed(declared),
            "",
        ),
    ]


def destination_checks(contract: Contract, destination: str) -> list[tuple]:
    return [
        (
            "destination_allowed",
            destination in contract.allowed_destinations,
            destination,
            Q.listed(contract.allowed_destinations),
            "",
        ),
        (
            "destination_not_forbidden",
            destination not in contract.forbidden_destinations,
            destination,
            Q.listed(contract.forbidden_destinations),
            "",
        ),
    ]


def privacy_checks(contract: Contract, destination: str, present: list[str]) -> list[tuple]:
    public = destination == "gold/public"
    pii = [c.name for c in contract.columns if c.pii]
    found = [c for c in contract.forbidden_fields if c in present]
    results = [
        (
            f"{c.name}_pii_destination_valid",
            not (public and c.pii),
            str(c.pii).lower(),
            "false" if public else "internal permitted",
            "",
        )
        for c in contract.columns
        if c.name in present
    ]
    safe = contract.classification.lower() != "public-safe" or not pii
    results.append(("forbidden_fields_absent", not found, Q.listed(found), "none", ""))
    results.append(
        ("public_safe_contract_has_no_pii", safe, Q.listed(pii), "none for Public-Safe", "")
    )
    return results


def metadata_checks(contract: Contract, expected_name: str) -> list[tuple]:
    missing = [
        name for name in REQUIRED_FIELDS if getattr(contract, name) in (None, "", [], {})
    ]
    flags = [flag for flag in COMPATIBILITY_FLAGS if flag not in contract.compatibility]
    slo = contract.freshness_slo_hours
    return [
        (
            "contract_dataset_matches_name",
            contract.dataset == expected_name,
            contract.dataset,
            expected_name,
            "",
        ),
        (
            "required_contract_metadata_present",
            not missing,
            Q.listed(missing),
            "none missing",
            "",
        ),
        ("compatibility_rules_complete", not flags, Q.listed(flags), "none missing", ""),
        ("freshness_slo_positive", bool(slo and slo > 0), str(slo), "> 0", ""),
    ]


def set_results(contracts: list[Contract], expected: list[str], outputs: list[str]) -> list[tuple]:
    """Results of a set of contracts: (dataset, check, ...). None is missing, each has its output."""
    names = {c.dataset for c in contracts}
    missing = [n for n in expected if n not in names]
    return [
        ("contracts", "all_contracts_present", not missing, Q.listed(missing), "none missing", ""),
        *[
            (n, "gold_output_exists", n in outputs, str(n in outputs).lower(), "true", "")
            for n in expected
        ],
    ]


def contracts_present(
    df: DataFrame, contracts: list[Contract], expected: list[str]
) -> DataFrame:
    return Q.metadata_table(df.sparkSession, set_results(contracts, expected, expected)[:1])


def metadata_results(
    contract: Contract, destination: str, name: str, present: list[str]
) -> list[tuple]:
    """Results that follow from the contract, the zone and the column names alone."""
    lost = [k for k in contract.primary_key if k not in present]
    return [
        *metadata_checks(contract, name),
        *destination_checks(contract, destination),
        *column_checks(contract, present),
        *privacy_checks(contract, destination, present),
        ("primary_key_columns_present", not lost, Q.listed(lost), "none missing", ""),
    ]


def _has_key(contract: Contract, present: list[str]) -> bool:
    return bool(contract.primary_key) and set(contract.primary_key) <= set(present)


def contract_row_checks(contract: Contract, df: DataFrame) -> list[Q.Check]:
    """Value counters, and NULL keys where the key's columns are there."""
    checks = value_checks(contract, dict(df.dtypes))
    if _has_key(contract, df.columns):
        checks.append(Q.key_not_null(contract.primary_key))
    return checks


def validate_contract(
    df: DataFrame, contract: Contract, destination: str, name: str
) -> DataFrame:
    """Every check of one contract against one dataset, from one pass and one grouping."""
    parts = [
        Q.metadata_checks(df, name, metadata_results(contract, destination, name, df.columns)),
        Q.run_checks(df, name, contract_row_checks(contract, df)),
    ]
    if _has_key(contract, df.columns):
        keys = {name: (df, contract.primary_key)}
        parts.append(Q.unique_rows_and_keys(keys, whole_rows=False))
    return Q.union_all(parts)


def forbidden_public_columns(columns: DataFrame) -> DataFrame:
    """Rows of a schema table whose column may not be public: exact name or name pattern."""
    lowered = F.lower("column_name")
    return columns.where(
        lowered.isin(*FORBIDDEN_PUBLIC_COLUMNS)
        | F.regexp_like(lowered, F.lit(SENSITIVE_NAME_PATTERN))
    )


def forbidden_name_parts(columns: list[str]) -> list[str]:
    """Column names that contain a forbidden part."""
    return sorted(
        {c.lower() for c in columns if any(p in c.lower() for p in FORBIDDEN_PUBLIC_PARTS)}
    )
