import pytest
from compare import assert_same

from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """Tables with contaminated documents, near copies, near lines and nested quotes."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from test_native_operators import contamination_case, line_case
    from test_parity_join import case

    docs, items = contamination_case()
    texts = [t for d, t in [*docs, *line_case(), *case(1)] if d is not None and len(t or "") < 20_000]
    talks = [
        (1, 0, "user", "How do I bake bread?\nIt never rises."), (1, 1, "assistant", "Use fresh yeast."), (1, 2, "user", "On Monday, A wrote:\n> how do I  bake *bread*?\n\nSee also the other thread."),
        (1, 3, "user", ">> How do I bake bread?\n> See also the other thread.\nWhich one?"), (1, 4, "assistant", "> Use fresh yeast.\n> > old words\n\nIt worked"), (1, 5, None, "> nobody said this\nHm <|end|>"),
        (1, 6, "user", "> Use fresh yeast."), (2, 0, "user", None), (2, 1, "assistant", "Hello"), (2, 1, "assistant", "Hello"), (3, 2, "user", "> deep\n\tx\n>y"), (3, 1, "user", "y\ndeep"), (3, 3, "user", "> x\nend"),
    ]
    talks += [(5, i, "user", "\n".join(f"{'>' * (j % 3)} line {(i * 7 + j) % 23}" for j in range(i % 9))) for i in range(60)] + [(6, 0, "user", "\n".join(f"line {i}" for i in range(300))), (6, 1, "user", "line 7"), (6, 2, "user", "\n".join(f"> line {i}" for i in range(100, 290)))]
    talks += [(4, i, "user", f"message {i}" + (f"\n> message {i - 2}" if i > 1 else "")) for i in range(600)]
    top = tmp_path_factory.mktemp("planted")
    seen = list({i: t for i, t in reversed(items) if i is not None}.items())
    for name, table in {
        "documents": pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}),
        "benchmark": pa.table({"item_id": pa.array([i for i, _ in seen], pa.int64()), "text": pa.array([t for _, t in seen], pa.string())}),
        "pages": pa.table({"page_id": pa.array(range(90), pa.int64()), "url": pa.array([f"http://{'spam' if i % 3 else 'Good'}.host{i % 2}.org/A/b-{i}.html" + "?q=1#x" * (i % 3) for i in range(86)] + [None, "", "no scheme", "://com/"], pa.string())}),
        "labels": pa.table({"doc_id": pa.array([*range(60), *range(40), None], pa.int64()), "quality": pa.array([int(i % 3 == 0) if i % 11 else None for i in range(101)], pa.int32()), "toxic": pa.array([0] * 101, pa.int32())}),
        "conversations": pa.table([pa.array([r[k] for r in talks], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.string(), pa.string()])], names=["conv_id", "turn", "role", "text"]),
    }.items():
        pq.write_table(table, top / f"{name}.parquet")
    return str(top)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle_on_planted_cases(spark, planted, name):
    assert_same(QUERIES[name](spark, planted), ORACLES[name], planted)
