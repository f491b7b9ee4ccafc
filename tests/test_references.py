from gridloom.operators import references


def test_only_types_that_are_referred_to_are_targets(spark, monkeypatch):
    """Bookings and rules, the largest tables, are asked for their references, once, and never for their keys."""
    rows = [("s", "b", "b:0:1", 1, "PRODUCT", None, None, None, "sku-1", "hut", None),
            ("s", "b", "b:0:2", 2, "PRODUCT", None, None, None, "sku-1", "tent", None),
            ("s", "b", "b:0:3", 3, "BOOKING", " SKU-1", "x@y.z", None, "sku-2", None, None),
            ("s", "b", "b:0:4", 4, "STAFFING_RULE", "sku-2", None, None, None, "hut", None)]
    canonical = spark.createDataFrame(rows, (
        "session_id string, batch_id string, record_id string, row_ord bigint, entity_type string, product string,"
        " traveler string, key_email string, key_code string, key_name string, external_id string")).selectExpr(
        "*", "named_struct('productRef', product, 'travelerRef', traveler, 'guideRef', cast(null as string),"
        " 'qualificationRef', cast(null as string)) AS data")
    asked, keys_of = set(), references.target_keys

    def seen(frame, scope):
        asked.update(r.entity_type for r in frame.select("entity_type").distinct().collect())
        return keys_of(frame, scope)

    monkeypatch.setattr(references, "target_keys", seen)
    got = {(r.record_id, r.field, r.target_record_id) for r in references.resolve_references(canonical).collect()}
    assert got == {("b:0:3", "productRef", "b:0:1"), ("b:0:3", "travelerRef", None), ("b:0:4", "productRef", None)}
    assert asked == {"PRODUCT"}
