"""Carried lifecycle state against one replay, and the landing zone against failures and repeats."""

import datetime as dt
import random

import pytest

from tideline.plans.queries import QUERIES
from tideline.sources import files
from tideline.streaming import landing, lifecycle

EVENTS = "sequence long, key string, cycle_id string, kind string, as_of timestamp_ntz"


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def arrivals(seed=4, n=400):
    rng = random.Random(seed)
    kinds = [*sorted(lifecycle.KINDS), "trial_requested", "renamed"]
    return [(k, f"k{rng.randrange(3)}", f"c{rng.randrange(6)}", rng.choice(kinds), day(k // 4 - (9 if rng.random() < 0.1 else 0))) for k in range(n)]


def rows(df):
    return sorted(map(tuple, df.select("sequence", "key", "kind", "outcome").collect()))


@pytest.mark.parametrize("batches", [1, 3])
def test_micro_batches_give_the_state_of_one_replay(spark, tmp_path, batches):
    held = arrivals()
    for k in range(batches):
        part = held[k * len(held) // batches : (k + 1) * len(held) // batches]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = lifecycle.judged_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start(str(tmp_path / "out"))
    done.awaitTermination()
    got = rows(spark.read.schema(lifecycle.JUDGED).parquet(str(tmp_path / "out")))
    assert got == rows(lifecycle.replayed(spark.createDataFrame(held, EVENTS)))
    assert {o for *_, o in got} == {"accepted", "late", "unknown", "no_cycle", "too_many_refits"}


def test_each_refusal_by_hand():
    events = [("c", "trial_requested", 5), ("c", "challenger_fitted", 4), ("c", "refit_failed", 5), ("d", "trial_decided", 6), ("c", "challenger_fitted", 6), ("c", "refit_failed", 7), ("c", "odd", 7), ("c", "promoted", 8), ("c", "trial_decided", 9), ("c", "trial_requested", 9), ("c", "refit_failed", 9)]
    cycles = {}
    assert [o for o, _ in lifecycle.judge(events, 0, cycles)] == ["accepted", "late", "accepted", "no_cycle", "accepted", "too_many_refits", "unknown", "accepted", "no_cycle", "accepted", "accepted"]
    assert cycles == {"c": 1}


PAGE = '<link rel="canonical" href="{url}"><h1>Market prices {month} (11-20)</h1><p>2026/02/24 09:30</p><table><tr><th>Product</th><th>Price</th><th>%</th></tr><tr><td>Steel</td><td>t</td><td>{price}</td><td>1.0</td><td>0.5</td></tr></table>'


def page(n, price="10.0"):
    return PAGE.format(url=f"u{n}", month=f"2026-0{n % 9 + 1}", price=price)


def land(path, pages):
    path.mkdir(parents=True)
    for name, html in pages.items():
        (path / f"{name}.html").write_text(html)


def stored(spark, root):
    of = lambda name, schema, *columns: sorted((tuple(r) for r in landing.batches(spark, root, name, schema).select(*columns).collect()), key=str)
    return of("snapshots", landing.SNAPSHOT, "source_url", "release_month"), of("prices", "source_url string, price double", "source_url", "price"), of("errors", landing.ERROR, "source_url", "reason")


def test_landing_zone(spark, tmp_path):
    root, zone = str(tmp_path / "store"), tmp_path / "zone"
    run = lambda: landing.ingest_landing(landing.landed_files(spark, str(zone), "*.html", 2), root).awaitTermination()
    land(zone / "a", {"1": page(1), "2": page(2), "bad": "<p>Please enable JavaScript and refresh the page</p>", "odd": '<link rel="canonical" href="u7"><h1>About us</h1>', "empty": "", "copy": page(1)})
    run()
    first = stored(spark, root)
    assert first[0] == [("u1", "2026-02"), ("u2", "2026-03")] and first[1] == [("u1", 10.0), ("u2", 10.0)]
    assert {r for _, r in first[2]} == {"no_address", "no_release_in_title"} and ("u7", "no_release_in_title") in first[2]
    run()  # nothing new
    assert stored(spark, root) == first
    land(zone / "b", {"1": page(1), "3": page(3), "again": page(2, "99.0"), "wait": page(4).replace("<h1>", "<p>Please enable JavaScript and refresh the page</p><h1>")})
    run()
    second = stored(spark, root)
    assert second[0] == [*first[0], ("u3", "2026-04")] and ("u4", "challenge") in second[2]
    assert ("u2", 99.0) not in second[1]  # an address that is stored is not read again


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    root, zone = str(tmp_path / "store"), tmp_path / "zone"
    land(zone / "a", {"1": page(1), "2": page(2)})
    land(zone / "b", {"3": page(3), "4": page(1)})
    read = lambda lot: spark.read.format("binaryFile").schema(landing.BINARY).load(str(zone / lot))
    store = landing.store_batch(root)
    store(read("a"), 0)
    store(read("b"), 1)
    once = stored(spark, root)
    for number, lot in ((1, "b"), (0, "a"), (1, "b")):
        store(read(lot), number)
        assert stored(spark, root) == once
    assert [u for u, _ in once[0]] == ["u1", "u2", "u3"]


def test_archives_land_beside_files(spark, tmp_path):
    root, zone = str(tmp_path / "store"), tmp_path / "zone"

    def run():
        raw = landing.landed_files(spark, str(zone), "*.html", 2).select("content", "modificationTime")
        landing.ingest_landing(raw.union(landing.landed_archives(spark, str(zone), "*.parquet", 2)), root).awaitTermination()

    def archive(name, *pages):
        spark.createDataFrame([(bytearray(p, "utf-8"),) for p in pages], "content binary").coalesce(1).write.parquet(str(zone / name))

    land(zone / "a", {"1": page(1), "2": page(2)})
    run()  # no archive yet
    assert stored(spark, root)[0] == [("u1", "2026-02"), ("u2", "2026-03")]
    archive("b", page(1), page(3), page(3), "", "<h1>line\r\nline</h1>", '<link rel="canonical" href="u7"><h1>About us</h1>')
    land(zone / "c", {"3": page(3), "4": page(4)})
    run()
    snapshots, prices, errors = stored(spark, root)
    assert [u for u, _ in snapshots] == ["u1", "u2", "u3", "u4"] and prices == [(u, 10.0) for u in ("u1", "u2", "u3", "u4")]
    assert errors == [("u7", "no_release_in_title"), (None, "no_address"), (None, "no_address")]
    archive("d", page(4), page(5))
    run()
    assert [u for u, _ in stored(spark, root)[0]] == ["u1", "u2", "u3", "u4", "u5"] and stored(spark, root)[2] == errors
    held = landing.batches(spark, root, "snapshots", landing.SNAPSHOT)
    assert held.where("source_url = 'u5'").first()["retrieved_at"].timestamp() == pytest.approx(next((zone / "d").glob("*.parquet")).stat().st_mtime, abs=1)


def test_only_releases_land_in_files_of_their_own(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "run_path", lambda spark, name: f"{tmp_path}/{name}")
    got = QUERIES["landed_pages"](spark, small).collect()
    zone, others = tmp_path / "landing" / "in", spark.read.parquet(f"{small}/pages.parquet").count()
    assert sorted(p.name for p in zone.rglob("*") if p.is_dir()) == ["archives", "lot=0", "lot=1"]  # no folder a page
    assert spark.read.parquet(str(zone / "archives")).count() == others and len(list(zone.rglob("*.parquet"))) < others / 4
    pages = [p.read_bytes().decode() for p in zone.rglob("*.txt")]
    releases = spark.read.parquet(str(tmp_path / "raw-pages"))
    again = releases.where("substring(title, 15, 4) < '1998'")
    assert sorted(pages) == sorted(r["raw"] + "\r" for r in releases.unionByName(again).select("raw").collect())  # a page a file
    assert sum(r["outcome"] in ("stored", "challenge") for r in got) == releases.count()
