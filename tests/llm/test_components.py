from retail_lake.llm import components as module


def test_a_chain_in_id_order_takes_few_rounds(spark, monkeypatch):
    calls, freeze = [], module.freeze

    def counted(df):
        calls.append(1)
        assert len(calls) <= 60
        return freeze(df)

    monkeypatch.setattr(module, "freeze", counted)
    edges = [(i, i + 1) for i in range(80)] + [(100, 101), (102, 101), (103, 103)]
    got = dict(map(tuple, module.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert set(got) == {*range(81), 100, 101, 102}
    assert len({got[i] for i in range(81)}) == 1 and len({got[i] for i in (100, 101, 102)}) == 1
    assert got[0] != got[100] and set(got.values()) <= set(got)
