"""Facts are made as far as they are asked for; rounds of types get shorter."""

from ferngraph.sources import gotypes
from ferngraph.sources.gofacts import CODE, DECLARED, PACKAGES, go_facts

TEXT = 'package a\n\nimport "m/b"\n\ntype T struct{ n int }\n\nfunc (t *T) Next() *T { return t }\nfunc New() *T { return &T{} }\nfunc F() { go func() { b.G() }() }\n'


def _files(spark, **texts):
    return spark.createDataFrame([(f"/x/{k}/a.go", bytearray(t.encode())) for k, t in texts.items()], "path string, content binary")


def test_only_facts_that_are_asked_for(spark):
    files = _files(spark, a=TEXT, b="package b\nfunc G() {}\n", bad='package bad\nimport "m/a"\nfunc {\n')
    whole = go_facts(spark, "/x", None, [("", "m")], files)
    for kinds in (PACKAGES, DECLARED, CODE):
        facts = go_facts(spark, "/x", None, [("", "m")], files, kinds=kinds)
        assert set(facts.tables) == kinds | {"errors"} and facts["errors"].count() == 1  # bodies are read all the same
        for k in kinds:
            assert sorted(map(repr, facts[k].collect())) == sorted(map(repr, whole[k].collect())), k
        assert {r.kind for r in facts.parsed.select("kind").distinct().collect()} <= kinds | {"errors"}


def test_rounds_read_what_still_waits(spark, monkeypatch):
    chain = "func Long() { New()" + ".Next()" * 9 + " }\n" + "".join(f"func S{k}() {{ New().Next() }}\n" for k in range(30))
    seen, made = [], gotypes.cut

    def counted(df, **sums):
        got = made(df, **sums)
        if "told" in sums:
            seen.append(got[1])
        return got

    monkeypatch.setattr(gotypes, "cut", counted)
    facts = go_facts(spark, "/x", None, [("", "m")], _files(spark, a=TEXT + chain, b="package b\nfunc G() {}\n"))
    edges = [r.callee for r in facts.call_edges().where("caller = 'm/a.Long'").collect()]
    assert sorted(edges) == ["(*m/a.T).Next"] * 9 + ["m/a.New"]
    rows = [n for n, _ in seen]
    assert len(rows) >= 10 and all(b < a for a, b in zip(rows, rows[1:-1], strict=False)) and rows[3] < rows[0] / 4
