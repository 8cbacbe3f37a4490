"""Fixed schemas. Nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw tables and their columns, in file order. Every column is text
# except the consent flag of the contact table.
RAW_COLUMNS: dict[str, list[str]] = {
    "customers": [
        "customer_id",
        "customer_unique_id",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
    ],
    "geolocation": [
        "geolocation_zip_code_prefix",
        "geolocation_lat",
        "geolocation_lng",
        "geolocation_city",
        "geolocation_state",
    ],
    "order_items": [
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        "shipping_limit_date",
        "price",
        "freight_value",
    ],
    "order_payments": [
        "order_id",
        "payment_sequential",
        "payment_type",
        "payment_installments",
        "payment_value",
    ],
    "order_reviews": [
        "review_id",
        "order_id",
        "review_score",
        "review_comment_title",
        "review_comment_message",
        "review_creation_date",
        "review_answer_timestamp",
    ],
    "orders": [
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    ],
    "products": [
        "product_id",
        "product_category_name",
        "product_name_lenght",
        "product_description_lenght",
        "product_photos_qty",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    ],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
    "product_category_name_translation": [
        "product_category_name",
        "product_category_name_english",
    ],
    "customer_contact": [
        "customer_id",
        "synthetic_email",
        "synthetic_phone",
        "marketing_consent",
        "pii_classification",
    ],
}

TYPED_RAW_COLUMNS = {("customer_contact", "marketing_consent"): T.BooleanType()}


def raw_schema(table: str, corrupt_column: str | None = None) -> T.StructType:
    """Schema of one raw table; ``corrupt_column`` catches malformed records."""
    fields = [
        T.StructField(name, TYPED_RAW_COLUMNS.get((table, name), T.StringType()), True)
        for name in RAW_COLUMNS[table]
    ]
    if corrupt_column:
        fields.append(T.StructField(corrupt_column, T.StringType(), True))
    return T.StructType(fields)


CHECK_RESULT_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType(), True)
        for name in (
            "dataset",
            "check_name",
            "status",
            "severity",
            "observed_value",
            "expected_value",
            "details",
        )
    ]
)

STAGE_RESULT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("stage_order", T.IntegerType()),
        T.StructField("stage_name", T.StringType()),
        T.StructField("script", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("log_path", T.StringType()),
    ]
)

FRESHNESS_CONTROL_SCHEMA = T.StructType(
    [
        T.StructField("dataset_name", T.StringType()),
        T.StructField("expected_publish_time", T.TimestampType()),
        T.StructField("actual_publish_time", T.TimestampType()),
        T.StructField("freshness_slo_hours", T.DoubleType()),
        T.StructField("freshness_status", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ]
)

RUN_RESULT_SCHEMA = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("unique_id", T.StringType()),
                        T.StructField("status", T.StringType()),
                        T.StructField("failures", T.LongType()),
                    ]
                )
            ),
        )
    ]
)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


_S, _B, _L, _D = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()
_AS = T.ArrayType(T.StringType())

POLICY_INPUT_SCHEMA = _struct(
    schema_version=_S,
    evaluation_stage=_S,
    experiment=_struct(condition=_S, scenario_id=_S, run_key=_S),
    controls=_struct(
        policy_as_code_required=_B,
        self_healing_permitted=_B,
        automatic_remediation_permitted=_B,
    ),
    git=_struct(branch=_S, commit=_S),
    release=_struct(target_layer=_S, promotion_requested=_B),
    metadata=_struct(required_fields_present=_B, resource_count=_L),
    schema_contract=_struct(
        governed_models=T.ArrayType(
            _struct(
                model=_S,
                exposure=_S,
                expected_column_count=_L,
                actual_column_count=_L,
                missing_columns=_AS,
                unexpected_columns=_AS,
                incompatible_type_changes=_AS,
            )
        )
    ),
    transformation=_struct(changed_models=_AS, unapproved_definitions=_AS, manifest_sha256=_S),
    privacy=_struct(public_models=_AS, forbidden_columns=_AS, detected_forbidden_columns=_AS),
    quality=_struct(status=_S, total_tests=_L, failed_tests=_L, critical_failures=_AS),
    freshness=_struct(
        status=_S,
        sources=T.ArrayType(
            _struct(source=_S, observed_age_seconds=_D, maximum_age_seconds=_D, status=_S)
        ),
    ),
    runtime=_struct(
        pipeline_status=_S,
        canonical_unchanged=_B,
        isolated_output_tables=_L,
        athena_failed_queries=_L,
    ),
)
