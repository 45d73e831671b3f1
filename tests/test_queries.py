"""Every query with SQL against an independent engine, and the same rows for any number of partitions."""

import os

import duckdb
import pytest

import __spark_entry__
from wavegrid.plans.oracle import SQL
from wavegrid.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def ordered(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, engine, name):
    found, columns = QUERIES[name](spark, SF), None
    names = sorted(found.columns)
    want = engine.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({SQL[name]})")
    columns = sorted(d[0] for d in want.description)
    assert columns == names
    assert ordered(map(tuple, found.select(*[f"`{c}`" for c in names]).collect())) == ordered(want.fetchall())


@pytest.mark.parametrize("name", ["q_subframe_choice", "q_stream_md5", "q_pack_variable", "q_frame_index"])
def test_partitions_do_not_matter(spark, name):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(ordered(map(tuple, QUERIES[name](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert results[0] == results[1] == results[2] and results[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and (name != "q_file_roundtrip" or all(r.identical for r in rows))


@pytest.mark.parametrize("name,exchanges", [("q_subframe_choice", 1), ("q_fixed_restore", 1), ("q_frame_cost", 2), ("q_residual_choice", 1)])
def test_samples_are_read_and_dealt_once(spark, name, exchanges):
    found = QUERIES[name](spark, SF)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") <= exchanges and "SortMergeJoin" not in plan


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(QUERIES) > 80
    assert __spark_entry__.entry(spark).count() > 0


def test_analysis_agrees_with_the_codec(spark):
    """The relational choice and the frame writer's cost the same."""
    import numpy as np

    from wavegrid import adapters
    from wavegrid.functions import frames as fr

    profile = fr.Profile(16, 4, 0, 6, False)
    bits = {(r.user_id, r.frame): (r.kind, r.order, r.bits) for r in QUERIES["q_subframe_choice"](spark, SF).collect()}
    blocks = adapters.blocks(adapters.sig_events(spark, SF), "user_id", 16).collect()
    assert len(blocks) == len(bits)
    for b in blocks:
        s = fr.analyse(np.array(b.xs, np.int64), 17, 44100, profile)
        assert bits[b.user_id, b.frame] == (s.kind, s.order if s.kind == "fixed" else None, s.bits) or s.kind == "constant"


@pytest.mark.parametrize("order,size", [(2, 64), (8, 256)])
def test_adaptive_choice_agrees_with_the_codec(spark, order, size):
    import numpy as np

    from wavegrid import adapters
    from wavegrid.functions import frames as fr
    from wavegrid.operators import cost, framing

    samples = adapters.sig_events(spark, SF)
    profile = fr.Profile(size, 4, order, 6, False)
    found = {(r.user_id, r.frame): r for r in cost.subframes_with_lpc(framing.fixed(samples, size, ["user_id"]), ["user_id"], 17, 44_100, order).collect()}
    blocks = adapters.blocks(samples, "user_id", size).collect()
    # streams that swing to and fro as well, so that adaptive predictors win
    r, rows = np.random.default_rng(1), []
    for s in range(4):
        x = 0.0
        for k in range(600):
            x = -0.97 * x + r.normal(0, 300)
            rows.append((s, k, int(x)))
    wave = spark.createDataFrame(rows, "user_id long, i long, x long")
    more = {(r.user_id, r.frame): r for r in cost.subframes_with_lpc(framing.fixed(wave, size, ["user_id"]), ["user_id"], 17, 44_100, order).collect()}
    for rows, every in ((found, blocks), (more, adapters.blocks(wave, "user_id", size).collect())):
        assert len(rows) == len(every)
        for b in every:
            s, r = fr.analyse(np.array(b.xs, np.int64), 17, 44_100, profile), rows[b.user_id, b.frame]
            assert (r.kind, r.bits) == (s.kind, s.bits) and (s.kind not in ("fixed", "lpc") or r.order == s.order)
    assert any(r.kind == "lpc" for r in more.values())


#: The SQL's cuts, and what stands for the whole.
WHOLE = {
    **dict.fromkeys(["q_comments_visible", "q_comments_group", "q_comments_replace", "q_comments_listagg"], [("substring(text, 1, 40)", "text")]),
    "q_comment_split": [("substring(CASE turn", "(CASE turn"), ("END, 1, 60)", "END)")],
    "q_text_projection": [("substring(text, 1, 8)", "text")],
    "q_cue_points": [(" FROM ev WHERE i < 20", " FROM ev")],
    "q_reconcile": [("WHERE user_id % 5 <> 0)", "WHERE user_id % 5 <> 0 OR user_id % 7 = 0)")],
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_input(spark, engine, name):
    sql = SQL[name]
    for cut, whole in WHOLE[name]:
        sql = sql.replace(cut, whole)
    found = QUERIES[name](spark, SF)
    names = sorted(found.columns)
    want = engine.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({sql})").fetchall()
    assert ordered(map(tuple, found.select(*[f"`{c}`" for c in names]).collect())) == ordered(want)


def test_every_stream_is_reconciled(spark, engine):
    found = [r.user_id for r in QUERIES["q_reconcile"](spark, SF).collect()]
    assert sorted(found) == [u for (u,) in engine.execute("SELECT DISTINCT user_id FROM events ORDER BY 1").fetchall()]


COLUMNS = {"conversations": "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR", "events": "event_id BIGINT, user_id BIGINT, value DOUBLE"}


def same_on(spark, folder, name, table, rows):
    """A query and its SQL without cuts agree on a table of these rows; returns what was found."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {table} ({COLUMNS[table]})")
    con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    found = QUERIES[name](spark, str(folder))
    names = sorted(found.columns)
    rows = found.select(*names).collect()
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({SQL[name + '_whole']})").fetchall()
    assert ordered(map(tuple, rows)) == ordered(want)
    return rows


def test_comments_without_a_key_are_visible(spark, tmp_path):
    found = same_on(spark, tmp_path, "q_comments_visible", "conversations", [(1, t, role, f"t{t}") for t in range(4) for role in (None, "user")])
    assert sorted(r.value for r in found if r.key is None) == ["t0", "t3"]


def test_cue_points_of_a_stream_without_an_id(spark, tmp_path):
    found = same_on(spark, tmp_path, "q_cue_points", "events", [(4 * k + i, u, 1.0) for k, u in enumerate((None, 3)) for i in range(4)])
    assert sorted(r.sample_offset for r in found if r.user_id is None) == [0, 588, 1176]


def test_nothing_is_split_without_role_or_text(spark, tmp_path):
    found = same_on(spark, tmp_path, "q_comment_split", "conversations", [(1, 2, None, "a=b"), (1, 3, "c=d", None), (1, 4, "user", "x=y")])
    assert sorted((r.turn, r.key, r.value) for r in found) == [(2, None, None), (3, None, None), (4, "user", "x=y")]


def test_nothing_joined_is_null(spark, tmp_path):
    found = same_on(spark, tmp_path, "q_comments_listagg", "conversations", [(1, 0, "user", None), (1, 1, "user", None), (2, 0, "user", ""), (3, 0, "user", "a"), (3, 1, "user", None), (3, 2, "user", "b")])
    assert sorted((r.conv_id, r.value) for r in found) == [(1, None), (2, ""), (3, "a,b")]


#: Keys with null texts first, last, between others, and only.
NULL_TEXTS = [(c, t, "assistant", text) for c, texts in enumerate([(None, "b", "a"), ("b", "a", None), ("b", None, "a"), (None, None)]) for t, text in enumerate(texts)]


def test_first_and_last_are_values(spark, tmp_path):
    found = same_on(spark, tmp_path, "q_comments_group", "conversations", NULL_TEXTS)
    assert sorted((r.conv_id, r.n, r.first, r.last) for r in found) == [(0, 3, "b", "a"), (1, 3, "b", "a"), (2, 3, "b", "a"), (3, 2, None, None)]


def test_last_of_the_others_is_a_value(spark, tmp_path):
    found = same_on(spark, tmp_path, "q_comments_replace", "conversations", NULL_TEXTS)
    assert sorted((r.conv_id, r.n, r["last"]) for r in found if r.key != "user") == [(0, 3, "a"), (1, 3, "a"), (2, 3, "a"), (3, 2, None)]


def test_last_of_one_position_does_not_depend_on_the_order(spark, tmp_path):
    rows = [(c, 0, "assistant", text) for c, texts in enumerate(["ab", "ba"]) for text in texts]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["last"] for r in QUERIES["q_comments_replace"](spark, str(tmp_path)).collect() if r.key != "user"] == ["b", "b"]


def test_headers_of_any_stream(spark, tmp_path):
    """Rates with the top bit set, rates beyond 20 bits, and a stream without an id. The SQL overflows from a rate of 2 ** 19 on, so the bits are taken apart here."""
    users = [0, 528, 529, 1065, 1066, 10**9, None]
    spark.createDataFrame([(2 * k + e, u, 1.0) for k, u in enumerate(users) for e in range(2)], "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.user_id: r for r in QUERIES["q_streaminfo_pack"](spark, str(tmp_path)).collect()}
    assert set(found) == set(users)
    assert [found[u].packed is None for u in users] == [False] * 4 + [True] * 3 and found[528].packed > 0 > found[529].packed
    for u in users[:-1]:
        r, asked = found[u], (u * 977 + 8000, u % 8 + 1, u % 29 + 4, 2)
        assert (r.rate, r.channels, r.bits, r.total) == asked
        if r.packed is not None:
            p = r.packed % (1 << 64)
            assert (p >> 44, (p >> 41 & 7) + 1, (p >> 36 & 31) + 1, p & ((1 << 36) - 1)) == asked
    assert found[None].total == 2 and found[None].rate is None


#: Queries that cost blocks.
COSTED = ["q_frame_cost", "q_residual_choice", "q_running_progress", "q_seek_offsets", "q_subframe_choice", "q_decode_batches", "q_streaminfo", "q_summary", "q_partition_choice", "q_subframe_lpc", "q_byte_counters"]


@pytest.mark.parametrize("name", COSTED)
def test_no_residual_becomes_a_row(spark, name):
    """A task holds its samples' sorts, and what it has for each block; neither orders nor partitions make rows of them."""
    found = QUERIES[name](spark, SF)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    before = plan[plan.index("MapInArrow") :]
    assert "Generate" not in plan and "Aggregate" not in before and before.count("Sort [") <= 3


@pytest.fixture(scope="module")
def odd_events(spark, tmp_path_factory):
    """Streams of one event, of equal ones, with nulls here and there, at the start and only, of values beyond 31 bits, and without an id."""
    import random

    folder, rng = tmp_path_factory.mktemp("odd"), random.Random(5)
    any_ = lambda n: [round(rng.uniform(0, 500), 2) for _ in range(n)]
    streams = [(1, any_(40)), (2, [5.0] * 33), (3, [None if rng.random() < 0.3 else v for v in any_(70)]), (4, [None] * 20), (5, [rng.choice((-1e7, 1e7)) * rng.random() for _ in range(40)]), (6, [None] * 16 + [1.0, 2.0]),
               (7, [3.5]), (8, [250.0] * 20), (9, [0.0] * 10 + [1e7] * 10 + [-1e7] * 12), (10, [7.0, None] * 16), (None, any_(21))]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events ({COLUMNS['events']})")
    con.executemany("INSERT INTO events VALUES (?, ?, ?)", [(k, u, v) for k, (u, v) in enumerate((u, v) for u, vs in streams for v in vs)])
    con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder), con


@pytest.mark.parametrize("name", COSTED)
def test_costs_of_odd_events(spark, odd_events, name):
    folder, con = odd_events
    found = QUERIES[name](spark, folder)
    names = sorted(found.columns)
    rows = ordered(map(tuple, found.select(*names).collect()))
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({SQL[name]})").fetchall()
    if name == "q_decode_batches":  # the SQL's join follows no stream without an id beyond its first frame
        rows, want = [r for r in rows if not r.endswith("None)")], [r for r in want if r[-1] is not None]
    assert rows and rows == ordered(want)


def test_blocks_are_whole(monkeypatch):
    import pyarrow as pa

    from wavegrid.operators import cost

    monkeypatch.setattr(cost, "HELD", 6)
    sizes = [1, 3, 25, 2, 6, 6, 1]
    rows = pa.table({"block": [b for b, n in enumerate(sizes) for _ in range(n)], "at": [i + 1 for n in sizes for i in range(n)]})
    for size in (1, 2, 5, 100):
        found = list(cost._whole(iter(rows.to_batches(max_chunksize=size))))
        assert pa.Table.from_batches(found).to_pydict() == rows.to_pydict()
        assert all(b.column(1)[0].as_py() == 1 for b in found) and (size == 100 or len(found) > 1)


def test_sums_beyond_64_bits(spark, tmp_path):
    """Residuals whose sums pass 64 bits: the predictors are left out, and nothing wraps around."""
    rows = [(i, 1, (-1.0) ** i * 9e15) for i in range(16)] + [(16 + i, 2, float(i)) for i in range(16)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.user_id: r for r in QUERIES["q_subframe_choice"](spark, str(tmp_path)).collect()}
    assert (found[1].kind, found[1].bits) == ("verbatim", 16 * 17 + 8) and found[2].kind == "fixed"
