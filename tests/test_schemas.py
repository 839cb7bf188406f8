"""Schema registry (S1-S3), in the style of the reference's schema tests."""

import pytest
from pyspark.sql import types as T

from furrow.sources import schemas as S


def test_registry_lists_five_schemas():
    assert [n for n, _ in S.list_schemas()] == ["contacts", "sales_orders", "manufacturing_orders",
                                                "products", "invoices"]


def test_unknown_schema_raises():
    with pytest.raises(ValueError, match="no schema"):
        S.get_schema("nope")


@pytest.mark.parametrize("name,fields", [
    ("contacts", ["first_name", "last_name", "email", "phone", "created_at"]),
    ("sales_orders", ["order_number", "customer_name", "customer_email", "total", "status"]),
    ("manufacturing_orders", ["work_order_number", "product_sku", "quantity", "work_center"]),
    ("products", ["sku", "name", "category", "unit_price", "is_active"]),
    ("invoices", ["invoice_number", "line_items_json", "tax_rate", "payment_method"]),
])
def test_fields_present(name, fields):
    s = S.get_schema(name)
    assert s.field_names()[0] == "id"
    for f in fields:
        assert f in s.field_names()


def test_time_field_is_first_timestamp():
    for s in S.SCHEMAS.values():
        ts = [f.name for f in s.generated_fields() if f.sql_type == "TIMESTAMP"]
        assert ts[0] == s.time_field


def test_types_and_metadata():
    s = S.get_schema("sales_orders")
    st = s.struct()
    assert st["id"].dataType == T.LongType() and st["id"].metadata["identity"]
    assert st["order_number"].metadata["unique"] and st["order_number"].metadata["max_len"] == 50
    assert st["order_date"].dataType == T.TimestampNTZType()
    assert st["total"].dataType == T.DecimalType(12, 2)
    assert st["ship_date"].nullable and not st["order_date"].nullable
    assert S.get_schema("invoices").struct()["tax_rate"].dataType == T.DecimalType(5, 4)
    assert "order_number STRING NOT NULL" in s.ddl()


def test_dialects():
    s = dict(S.get_schema("contacts").sql_columns("mysql"))
    assert s["id"].startswith("INT AUTO_INCREMENT") and s["created_at"] == "DATETIME"
    d = dict(S.get_schema("contacts").sql_columns("duckdb"))
    assert d["id"].startswith("INTEGER")
    p = dict(S.get_schema("contacts").sql_columns("postgres"))
    assert p["id"] == "SERIAL PRIMARY KEY"


def test_search_mapping():
    m = S.get_schema("contacts").search_mapping()["mappings"]["properties"]
    assert m["first_name"] == {"type": "text", "fields": {"keyword": {"type": "keyword"}}}
    assert m["email"] == {"type": "keyword"}
    assert m["created_at"] == {"type": "date"}
    assert m["id"] == {"type": "integer"}
