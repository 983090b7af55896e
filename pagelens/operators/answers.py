"""What models say: questions from dead index links, answers held against what was observed, hosts that are cited. No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# Topics too general to have one answer, least length of a topic, questions a site, samples that make a majority, characters that end a URL in prose.
GENERAL = ("overview", "introduction", "intro", "docs", "documentation", "getting started", "guide", "guides", "reference", "api", "api reference", "home", "index", "faq", "changelog")
LEAST_TOPIC, MOST_QUESTIONS, MAJORITY = 3, 15, 3
URL_IN_TEXT = r"""https?://[^\s<>"'`)\]},*；。，\x00-\x1f\x7f]+"""


def question_id(domain: Column, topic: Column) -> Column:
    return F.substring(F.sha1(F.encode(F.concat_ws("|", domain, F.lit("doc_url"), F.lower(F.trim(topic))), "utf-8")), 1, 12)


def undecidable(facts: DataFrame) -> DataFrame:
    """Add why to facts (domain, url, topic, index_text): too_short, too_general, ambiguous (several dead URLs for one topic), not_in_index; null where a question can be judged."""
    t = F.trim(F.coalesce("topic", F.lit("")))
    key = F.lower(t)
    same = facts.groupBy("domain", key.alias("_key")).agg(F.countDistinct("url").alias("_n"))
    j = facts.withColumn("topic", t).withColumn("_key", key).join(same, ["domain", "_key"])
    why = (
        F.when(F.char_length("topic") < LEAST_TOPIC, "too_short").when(F.col("_key").isin(*GENERAL), "too_general").when(F.col("_n") > 1, "ambiguous")
        .when(F.col("index_text").isNotNull() & ~F.contains(F.col("index_text"), F.col("topic")), "not_in_index")
    )
    return j.select(*facts.columns, why.alias("why"))


def questions(facts: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """Questions on dead index links (domain, url, topic, index_text, ord), at most `most` a domain, spread over path families: one of each family in turn. (domain, rank, qid, topic, known_dead_url, text)"""
    family = F.when(F.size(U.path_segments(U.part(F.col("url"), 3))) == 0, "/").otherwise(F.array_join(F.slice(U.path_segments(U.part(F.col("url"), 3)), 1, 2), "/"))
    q = undecidable(facts).filter("why is null").withColumn("family", family)
    deep = q.groupBy("domain", "family").agg(F.array_sort(F.collect_list(F.struct("ord", "url", "topic"))).alias("m")).select("domain", "family", F.posexplode("m").alias("depth", "x"))
    top = deep.groupBy("domain").agg(F.slice(F.array_sort(F.collect_list(F.struct("depth", "family", "x"))), 1, most).alias("t")).select("domain", F.posexplode("t").alias("rank", "t"))
    topic = F.col("t.x.topic")
    text = F.format_string("Where can I find the %s documentation page about %s? Reply with the URL.", F.col("domain"), topic)
    return top.select("domain", "rank", question_id(F.col("domain"), topic).alias("qid"), topic.alias("topic"), F.col("t.x.url").alias("known_dead_url"), text.alias("text"))


def urls_in(text: Column) -> Column:
    """URLs in running text, without trailing signs, each once in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL_IN_TEXT), 0)
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}'\"`>*_]+$", "")), lambda u: u != ""))


def reconcile(asked: DataFrame, answers: DataFrame, dead: DataFrame, living: DataFrame) -> DataFrame:
    """Each question (qid, topic, known_dead_url) against its recorded samples (qid, sample_idx, text, citations): status, model_url and counts.

    A sample votes by the first URL of its text. no_url: none has one. unstable: several URLs and none with MAJORITY votes. Else the URL with most votes (the first
    given on a tie) is cites_dead, match or unverifiable, as it is in dead (url), living (url) or neither. evidence is cited if a structured citation holds it, else stated_only.
    """
    a = answers.select("qid", "sample_idx", F.transform(urls_in(F.col("text")), U.comparable).alias("urls"), F.transform(F.coalesce("citations", F.array().cast("array<string>")), U.comparable).alias("cited"))
    n = a.groupBy("qid").agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.size("urls") > 0).alias("n_with_url"))
    votes = a.filter(F.size("urls") > 0).groupBy("qid", F.col("urls")[0].alias("url")).agg(F.count(F.lit(1)).alias("votes"), F.min("sample_idx").alias("first"))
    best = votes.groupBy("qid").agg(F.max(F.struct("votes", (-F.col("first")).alias("f"), "url")).alias("b"), F.count(F.lit(1)).alias("n_distinct"))
    cited = a.select("qid", F.explode("cited").alias("url")).filter("url <> ''").groupBy("qid", "url").agg(F.count(F.lit(1)).alias("c"))
    total = cited.groupBy("qid").agg(F.sum("c").alias("c_all"))
    mark = lambda df, name: df.select(U.comparable(F.col("url")).alias("url")).distinct().withColumn(name, F.lit(True))
    j = asked.join(n, "qid", "left").join(best, "qid", "left").withColumn("url", F.col("b.url")).join(cited, ["qid", "url"], "left").join(total, "qid", "left").join(mark(dead, "_dead"), "url", "left").join(mark(living, "_live"), "url", "left")
    unstable = (F.col("b.votes") < MAJORITY) & (F.col("n_distinct") > 1)
    status = F.when(F.col("b").isNull(), "no_url").when(unstable, "unstable").when(F.col("_dead"), "cites_dead").when(F.col("_live"), "match").otherwise("unverifiable")
    n_cited = F.coalesce(F.when(unstable, F.col("c_all")).otherwise(F.col("c")), F.lit(0))
    evidence = F.when(F.col("b").isNull(), "none").when(n_cited > 0, "cited").otherwise("stated_only")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    r = j.select(*asked.columns, status.alias("status"), evidence.alias("evidence"), F.when(~F.coalesce(unstable, F.lit(True)), F.col("url")).alias("model_url"), zero("n_samples").alias("n_samples"), zero("n_with_url").alias("n_with_url"), zero("n_distinct").alias("n_distinct"), F.coalesce("b.votes", F.lit(0)).alias("n_votes"), n_cited.alias("n_cited"))
    return r.withColumn("is_hit", F.col("status").isin("cites_dead", "unstable"))


def offsite_findings(hosts: DataFrame, dns: DataFrame) -> DataFrame:
    """Cited hosts (pages.cited_hosts) that are worth telling: foreign ones whose name does not resolve, previews with a name not meant to be public."""
    j = hosts.join(dns.select("host", F.col("ok").alias("resolves")), "host", "left")
    asked = F.when(F.col("to_probe"), F.col("resolves"))
    finding = (F.col("host_class") != "own") & (F.coalesce(~asked, F.lit(False)) | ((F.col("host_class") == "preview") & F.col("mark").isNotNull()))
    return j.withColumn("is_finding", finding).orderBy(F.desc("n_citations"), "host")


def answer_text(payload: Column) -> Column:
    """The text of a recorded response: all `text` values of output_text items in order, else output_text itself."""
    shape = "struct<output:array<struct<content:array<struct<type:string,text:string,annotations:array<struct<type:string,url:string>>>>>>,output_text:string>"
    r = F.from_json(payload, shape)
    parts = F.flatten(F.transform(r["output"], lambda o: F.coalesce(o["content"], F.array())))
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "output_text") & p["text"].isNotNull()), lambda p: p["text"])
    return F.trim(F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, F.array_join(texts, "\n")).otherwise(F.coalesce(r["output_text"], F.lit(""))))


def answer_citations(payload: Column) -> Column:
    """URLs of a recorded response's url_citation annotations, each once in order."""
    shape = "struct<output:array<struct<content:array<struct<annotations:array<struct<type:string,url:string>>>>>>>"
    r = F.from_json(payload, shape)
    notes = F.flatten(F.transform(F.flatten(F.transform(r["output"], lambda o: F.coalesce(o["content"], F.array()))), lambda p: F.coalesce(p["annotations"], F.array())))
    return F.coalesce(F.array_distinct(F.transform(F.filter(notes, lambda n: (n["type"] == "url_citation") & (F.coalesce(n["url"], F.lit("")) != "")), lambda n: n["url"])), F.array().cast("array<string>"))
