"""The marketplace data model: nine tables, their keys and their references."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "money": T.DecimalType(18, 2),
    "time": T.TimestampNTZType(),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


# Table and column names of the data set (two of them are misspelled there).
RAW_SCHEMAS = {
    "customers": _schema(
        customer_id="string",
        customer_unique_id="string",
        customer_zip_code_prefix="string",
        customer_city="string",
        customer_state="string",
    ),
    "sellers": _schema(
        seller_id="string",
        seller_zip_code_prefix="string",
        seller_city="string",
        seller_state="string",
    ),
    "products": _schema(
        product_id="string",
        product_category_name="string",
        product_name_lenght="string",
        product_description_lenght="string",
        product_photos_qty="string",
        product_weight_g="string",
        product_length_cm="string",
        product_height_cm="string",
        product_width_cm="string",
    ),
    "orders": _schema(
        order_id="string",
        customer_id="string",
        order_status="string",
        order_purchase_timestamp="string",
        order_approved_at="string",
        order_delivered_carrier_date="string",
        order_delivered_customer_date="string",
        order_estimated_delivery_date="string",
    ),
    "order_items": _schema(
        order_id="string",
        order_item_id="int",
        product_id="string",
        seller_id="string",
        shipping_limit_date="string",
        price="money",
        freight_value="money",
    ),
    "payments": _schema(
        order_id="string",
        payment_sequential="int",
        payment_type="string",
        payment_installments="int",
        payment_value="money",
    ),
    "reviews": _schema(
        review_id="string",
        order_id="string",
        review_score="int",
        review_comment_title="string",
        review_comment_message="string",
        review_creation_date="string",
        review_answer_timestamp="string",
    ),
    "geolocation": _schema(
        geolocation_zip_code_prefix="string",
        geolocation_lat="double",
        geolocation_lng="double",
        geolocation_city="string",
        geolocation_state="string",
    ),
    "category_translation": _schema(
        product_category_name="string",
        product_category_name_english="string",
    ),
}

# Columns that the cleaning rules name.
ORDER_DATE_COLUMNS = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]
REVIEW_DATE_COLUMNS = ["review_creation_date", "review_answer_timestamp"]
REVIEW_TEXT_COLUMNS = ["review_comment_title", "review_comment_message"]
PRODUCT_NUMERIC_COLUMNS = [
    "product_name_lenght",
    "product_description_lenght",
    "product_photos_qty",
    "product_weight_g",
    "product_length_cm",
    "product_height_cm",
    "product_width_cm",
]

# Key of each cleaned table.
PRIMARY_KEYS = {
    "customers": "customer_id",
    "sellers": "seller_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_item_key",
    "payments": "payment_id",
    "reviews": "review_key",
    "geolocation": "geolocation_zip_code_prefix",
    "category_translation": "product_category_name",
}

# Check name -> (child table, parent table, shared column).
FOREIGN_KEYS = {
    "orders -> customers": ("orders", "customers", "customer_id"),
    "items -> products": ("order_items", "products", "product_id"),
    "items -> sellers": ("order_items", "sellers", "seller_id"),
    "items -> orders": ("order_items", "orders", "order_id"),
    "reviews -> orders": ("reviews", "orders", "order_id"),
    "payments -> orders": ("payments", "orders", "order_id"),
}
