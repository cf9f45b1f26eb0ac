import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators.intake import parse_chargebacks, parse_transactions, quarantined, reason_counts, to_bronze, valid_chargebacks, valid_transactions
from ledgerlark.plans.contracts import BRONZE, CHARGEBACK, LOG_RECORD, QUARANTINE, TRANSACTION

NOW = datetime(2026, 9, 24, 12, 0, 5)
TXN = {"schema_version": 1, "transaction_id": "t1", "event_ts": "2026-09-24T12:00:00.123Z", "user_id": "u", "card_id": "c", "merchant_id": "m", "amount": 100.0, "currency": "EUR", "channel": "POS", "entry_mode": "CHIP", "location_lat": 48.8, "location_lon": 2.3, "city": "Paris", "country_code": "fr"}
CB = {"schema_version": 1, "chargeback_id": "b1", "transaction_id": "t1", "user_id": "u", "reason_code": "10.4", "amount": 20.0, "currency": "GBP", "reported_ts": "2026-09-24T12:00:00Z"}


def bronze(spark, *payloads):
    rows = [(bytearray(b"k"), None if p is None else bytearray(p.encode()), "t", 0, k, NOW) for k, p in enumerate(payloads)]
    return to_bronze(spark.createDataFrame(rows, LOG_RECORD))


def change(base, **kw):
    return json.dumps({k: v for k, v in {**base, **kw}.items() if v != "DROP"})


@pytest.mark.parametrize(
    "payload, reason",
    [
        (json.dumps(TXN)[:60], "MALFORMED_JSON"),
        ("[1]", "MALFORMED_JSON"),
        (change(TXN, amount="much"), "MALFORMED_JSON"),
        (change(TXN, amount=-5), "INVALID_AMOUNT"),
        (change(TXN, amount=1_000_000.01), "INVALID_AMOUNT"),
        (change(TXN, merchant_id="DROP"), "MISSING_REQUIRED_FIELD"),
        (change(TXN, currency="XXX"), "UNKNOWN_CURRENCY"),
        (change(TXN, currency="eur"), "UNKNOWN_CURRENCY"),
        (change(TXN, location_lat=123.4), "INVALID_COORDINATES"),
        (change(TXN, event_ts="not-a-timestamp"), "INVALID_TIMESTAMP"),
        (change(TXN, event_ts="2026-09-24T13:00:00Z"), "FUTURE_TIMESTAMP"),
        (change(TXN, schema_version=2), "UNSUPPORTED_SCHEMA_VERSION"),
        (change(TXN, channel="TELEPATHY"), "INVALID_CHANNEL"),
        ("", "MISSING_REQUIRED_FIELD"),
        (None, "UNSUPPORTED_SCHEMA_VERSION"),
    ],
)
def test_bad_transactions_have_their_reason(spark, payload, reason):
    rows = parse_transactions(bronze(spark, payload))
    assert reason in rows.first()["dq_errors"]
    assert valid_transactions(rows).count() == 0
    bad = quarantined(rows)
    assert bad.columns == QUARANTINE.names and bad.first()["raw_payload"] == payload


def test_good_transactions_meet_the_contract(spark):
    rows = parse_transactions(bronze(spark, json.dumps(TXN), change(TXN, amount="12.5", extra=1), change(TXN, channel="DROP", location_lat="DROP"), change(TXN, amount=10.005)))
    good = valid_transactions(rows)
    assert [(f.name, f.dataType) for f in good.schema] == [(f.name, f.dataType) for f in TRANSACTION]
    first, second, third, fourth = good.orderBy("kafka_offset").collect()
    assert float(first.amount_usd) == 109.0 and first.event_ts.microsecond == 123_000 and first.country_code == "FR"
    assert float(second.amount) == 12.5 and third.channel is None and float(fourth.amount) == 10.01
    assert bronze(spark, "x").columns == BRONZE.names


@pytest.mark.parametrize("kw, reason", [({"reason_code": "99.9"}, "UNKNOWN_REASON_CODE"), ({"reported_ts": "DROP"}, "INVALID_TIMESTAMP"), ({"currency": "DROP"}, "UNKNOWN_CURRENCY"), ({"amount": 0}, "INVALID_AMOUNT"), ({"user_id": "DROP"}, "MISSING_REQUIRED_FIELD")])
def test_bad_chargebacks(spark, kw, reason):
    assert reason in parse_chargebacks(bronze(spark, change(CB, **kw))).first()["dq_errors"]


def test_good_chargebacks_whatever_their_version(spark):
    rows = parse_chargebacks(bronze(spark, change(CB, schema_version=7), change(CB)))
    good = valid_chargebacks(rows)
    assert good.columns == CHARGEBACK.names and [float(r.amount_usd) for r in good.collect()] == [25.4, 25.4]


def test_text_is_parsed_once(spark):
    plan = valid_transactions(parse_transactions(bronze(spark, "{}")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_reason_counts(spark):
    rows = quarantined(parse_transactions(bronze(spark, "", change(TXN, amount=-1), change(TXN, amount=-1, channel="X"))))
    assert {r.reason: r.records for r in reason_counts(rows).collect()} == {"UNSUPPORTED_SCHEMA_VERSION": 1, "MISSING_REQUIRED_FIELD": 1, "INVALID_AMOUNT": 2, "INVALID_CHANNEL": 1}
    assert reason_counts(rows.where(F.lit(False))).count() == 0


def test_zero_amounts_are_invalid_unless_let_through(spark):
    rows = bronze(spark, change(TXN, amount=0), change(TXN, amount=-0.01))
    assert [r.dq_errors for r in parse_transactions(rows).collect()] == [["INVALID_AMOUNT"]] * 2
    assert [r.dq_errors for r in parse_transactions(rows, zero_amounts=True).collect()] == [[], ["INVALID_AMOUNT"]]
