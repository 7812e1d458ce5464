"""Fixed schemas of the batch sources and the event streams, and the domain's enumerations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_NAMES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "map<string;string>": T.MapType(T.StringType(), T.StringType())}


def schema_of(ddl: str) -> T.StructType:
    """A schema from "name type, .."; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(n, _NAMES[t]) for n, t in (f.split() for f in ddl.split(","))])


_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "m": T.DecimalType(18, 2), "d": T.DoubleType(), "t": T.TimestampType()}


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    required: bool


@dataclass(frozen=True)
class Contract:
    """A CSV source: its file, key and fields in the order that the header must have."""

    name: str
    file: str
    key: tuple[str, ...]
    fields: tuple[Field, ...]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    def schema(self, corrupt: str | None = None) -> T.StructType:
        """All fields nullable, as required ones are checked by quarantine, not by the reader."""
        fields = [T.StructField(f.name, f.type) for f in self.fields]
        return T.StructType(fields + ([T.StructField(corrupt, T.StringType())] if corrupt else []))

    def check_header(self, header: list[str]) -> None:
        """Raises unless the header has exactly the contract's columns in their order."""
        if list(header) != self.columns:
            lacking, extra = sorted(set(self.columns) - set(header)), sorted(set(header) - set(self.columns))
            raise ValueError(f"{self.name}: header differs (missing {lacking}, unexpected {extra})" if lacking or extra else f"{self.name}: columns out of order")


def _contract(name: str, file: str, key: str, fields: str) -> Contract:
    parsed = []
    for f in fields.split():
        n, kind = f.split(":")
        parsed.append(Field(n, _TYPES[kind[0]], kind.endswith("!")))
    return Contract(name, file, tuple(key.split()), tuple(parsed))


_ALL = (
    _contract("customers", "olist_customers_dataset.csv", "customer_id", "customer_id:s! customer_unique_id:s! customer_zip_code_prefix:i! customer_city:s! customer_state:s!"),
    _contract("geolocation", "olist_geolocation_dataset.csv", "geolocation_zip_code_prefix geolocation_lat geolocation_lng", "geolocation_zip_code_prefix:i! geolocation_lat:d! geolocation_lng:d! geolocation_city:s! geolocation_state:s!"),
    _contract("order_items", "olist_order_items_dataset.csv", "order_id order_item_id", "order_id:s! order_item_id:i! product_id:s! seller_id:s! shipping_limit_date:t! price:m! freight_value:m!"),
    _contract("payments", "olist_order_payments_dataset.csv", "order_id payment_sequential", "order_id:s! payment_sequential:i! payment_type:s! payment_installments:i! payment_value:m!"),
    _contract("reviews", "olist_order_reviews_dataset.csv", "review_id order_id", "review_id:s! order_id:s! review_score:i! review_comment_title:s review_comment_message:s review_creation_date:t! review_answer_timestamp:t!"),
    _contract("orders", "olist_orders_dataset.csv", "order_id", "order_id:s! customer_id:s! order_status:s! order_purchase_timestamp:t! order_approved_at:t order_delivered_carrier_date:t order_delivered_customer_date:t order_estimated_delivery_date:t!"),
    _contract("products", "olist_products_dataset.csv", "product_id", "product_id:s! product_category_name:s product_name_lenght:i product_description_lenght:i product_photos_qty:i product_weight_g:i product_length_cm:i product_height_cm:i product_width_cm:i"),
    _contract("sellers", "olist_sellers_dataset.csv", "seller_id", "seller_id:s! seller_zip_code_prefix:i! seller_city:s! seller_state:s!"),
    _contract("category_translation", "product_category_name_translation.csv", "product_category_name", "product_category_name:s! product_category_name_english:s!"),
)
CONTRACTS = {c.name: c for c in _ALL}


def contract(name: str) -> Contract:
    if name not in CONTRACTS:
        raise KeyError(f"no source named {name!r}; there are {', '.join(sorted(CONTRACTS))}")
    return CONTRACTS[name]


EVENT_VERSION = "1.0.0"
DELIVERY_EVENT = schema_of("schema_version string, event_id string, order_id string, status string, occurred_at timestamp, produced_at timestamp, location_state string, carrier_code string, sequence_number int, attributes map<string;string>")
CLICK_EVENT = schema_of("schema_version string, event_id string, user_id string, anonymous_id string, session_source_id string, event_type string, occurred_at timestamp, product_id string, order_id string, device_type string, traffic_source string")

ORDER_STATUSES = ("created", "approved", "invoiced", "processing", "shipped", "delivered", "unavailable", "canceled")
#: key, status, group
ORDER_STATUS_ROWS = (
    (10, "created", "open"), (20, "approved", "open"), (30, "invoiced", "open"), (40, "processing", "open"), (50, "shipped", "in_transit"),
    (60, "delivered", "success"), (70, "unavailable", "failure"), (80, "canceled", "failure"), (-1, "unknown", "unknown"),
)
CLICK_TYPES = tuple("page_view product_view add_to_cart checkout purchase".split())
#: the delivery's steps in their order; an exception stands outside it
STEPS = tuple("created approved invoiced shipped in_transit out_for_delivery delivered".split())
DELIVERY_RANKS = {s: 10 * i for i, s in enumerate(STEPS, 1)} | {"exception": 90}
TRANSITIONS = frozenset(zip(STEPS, STEPS[1:])) | {(s, "exception") for s in STEPS[3:6]} | {("exception", s) for s in STEPS[4:6]}


def transition_allowed(previous: str | None, current: str) -> bool:
    """A first status must be ``created``; a repeated one is allowed; else the pair must be."""
    return current == "created" if previous is None else previous == current or (previous, current) in TRANSITIONS
