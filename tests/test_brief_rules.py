"""Rule ids and severities are found without the wording of the findings, and stay in step with them."""

from pyspark.sql import functions as F

from threatlake.catalog.endpoint import observed
from threatlake.functions.findings import RULES, as_rules
from threatlake.operators.dedup import suppress
from threatlake.operators.evaluate import evaluate
from threatlake.plans.timeline import judged_events
from threatlake.session import put_down
from threatlake.sources.feeds import load_feeds

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_are_those_of_the_findings_and_cost_no_sentences(spark):
    events = put_down(observed(spark, SF))
    judged = evaluate(events, load_feeds(spark))
    assert judged.where(as_rules("findings") != F.col(RULES)).count() == 0 and judged.where(F.size(RULES) > 1).count() > 100
    words = "a usual step of macro malware"
    assert words in plan(judged.select("findings"))
    assert words not in plan(judged.select("seq", RULES, "score", "severity", "summary"))


def test_rules_follow_correlation_and_suppression(spark):
    kept = put_down(suppress(put_down(judged_events(put_down(observed(spark, SF)), load_feeds(spark))), 86400))
    assert kept.where(as_rules("findings") != F.col(RULES)).count() == 0 and kept.where("suppressed_duplicates > 0").count() > 0
    assert kept.where(F.exists("findings", lambda f: f["rule_id"].startswith("CORR_DOWNLOAD"))).count() > 0
