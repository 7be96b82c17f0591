"""Queries of the reference's operators read every row of their tables."""

from curata.plans import catalog

SF = "/root/testdata/sf0.01"


def test_facts_lookup_join_reads_all_facts(spark):
    newest = {}
    for r in catalog.documents(spark, SF).select("doc_id").collect():
        newest[str(r.doc_id % 97)] = max(r.doc_id, newest.get(str(r.doc_id % 97), r.doc_id))
    got = catalog.QUERIES["facts_lookup_join"](spark, SF).collect()
    assert len(got) == catalog.titles(spark, SF).count()
    assert all(r.fact_doc == newest.get(r.image_id) and r.vlm_parse_used == (r.image_id in newest) for r in got)
    assert any(not r.vlm_parse_used for r in got) and any(r.vlm_parse_used and r.image_id > "6" for r in got)
    assert any(r.vlm_parse_used and r.fact_doc % 5 == 0 for r in got)


def test_plan_prompt_keeps_the_repeated_cue(spark):
    fives = {r.article_id for r in catalog.titles(spark, SF).where("image_id = '5'").collect()}
    got = {r.article_id: r.prompt for r in catalog.QUERIES["plan_prompt"](spark, SF).collect()}
    assert len(got) == catalog.titles(spark, SF).count() and fives
    assert all(got[i].lower().count(", cue 5, symbolic") == 1 and got[i].count("Cue 5") == 0 for i in fives)
