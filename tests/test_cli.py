import threading

import pytest

from ledgerlark.__main__ import main, parser
from ledgerlark.operators.seeding import enriched_transactions
from ledgerlark.settings import Settings
from ledgerlark.sources.tables import FACT_TRANSACTIONS, Warehouse


def test_settings():
    s = Settings.load({"LEDGER_SEED": "7", "LEDGER_TRIGGER": "", "LEDGER_FRAUD_RATE": "0.5"})
    assert (s.seed, s.trigger, s.fraud_rate) == (7, "2 seconds", 0.5)
    with pytest.raises(ValueError):
        Settings.load({"LEDGER_SEED": "many"})


def test_arguments():
    with pytest.raises(SystemExit):
        main(["stream", "--layers", "bronze,platinum"])
    with pytest.raises(SystemExit):
        parser().parse_args(["reconcile"])
    assert parser().parse_args(["reconcile", "--date", "2026-01-01"]).label_maturity_hours == 24


def test_the_ready_file_is_there_while_queries_run(spark, tmp_path, monkeypatch):
    ready, seen = tmp_path / "ready", []
    s = Settings(drops=str(tmp_path / "drops"), lake=str(tmp_path / "lake"), warehouse=str(tmp_path / "dw"), users=5, merchants=5, ready_file=str(ready), trigger="0 seconds", slow_trigger="0 seconds")
    for t in (s.transactions_topic, s.chargebacks_topic, "transactions", "chargebacks"):
        (tmp_path / "drops" / t).mkdir(parents=True)
    ready.touch()
    assert main(["seed"], spark, s) == 0
    asked = threading.Event

    class Soon(asked):
        def wait(self, timeout=None):
            if timeout == 1.0 and not self.is_set():
                seen.append(ready.exists())
                self.set()
            return super().wait(timeout)

    monkeypatch.setattr("ledgerlark.__main__.threading.Event", Soon)
    assert main(["stream", "--no-metrics"], spark, s) == 0 and seen == [True] and not ready.exists()


def test_generate_seed_stream_reconcile(spark, tmp_path, capsys):
    s = Settings(drops=str(tmp_path / "drops"), lake=str(tmp_path / "lake"), warehouse=str(tmp_path / "dw"), users=30, merchants=12)
    assert main(["generate", "--rate", "20", "--duration", "30", "--fraud-rate", "0.1", "--workers", "2"], settings=s) == 0
    assert main(["generate", "--rate", "5", "--duration", "4", "--dry-run"], settings=s) == 0 and len(list((tmp_path / "drops" / "transactions").iterdir())) == 8
    assert main(["seed"], spark, s) == 0 and main(["seed"], spark, s) == 0
    assert main(["seed", "--simulate-upgrades", "5"], spark, s) == 0
    out = capsys.readouterr().out
    assert "'users': (30, 0)" in out and "'users': (0, 0)" in out and "'users': (5, 5)" in out and "'merchants': (12, 0)" in out
    assert main(["stream", "--once"], spark, s) == 0
    w = Warehouse(spark, s.warehouse)
    facts = w.read(FACT_TRANSACTIONS.table)
    n = facts.count()
    assert n > 500 and facts.where("user_key = -1 OR merchant_key = -1").count() == 0
    day = str(facts.selectExpr("max(to_date(event_ts))").first()[0])
    assert main(["reconcile", "--date", day], spark, s) == 0
    assert "'missing': 0" in capsys.readouterr().out and w.read("reconciliation_runs").first().status == "SUCCEEDED"
    # Maintenance has copied the day into few files; another run reads the copy.
    assert main(["reconcile", "--date", day], spark, s) == 0 and "'missing': 0" in capsys.readouterr().out
    assert day in Warehouse(spark, f"{s.lake}/_compacted").version("gold_transactions").segments
    view = enriched_transactions(w)
    assert 0 < view.count() <= n and view.where("segment IS NULL OR category_name IS NULL").count() == 0
    ages = w.read("dim_users").selectExpr("count(DISTINCT account_open_date)").first()[0]
    assert ages > 10
    assert spark.read.parquet(f"{s.lake}/ops_progress").count() > 0
