"""Queries of the variant-spelling problem."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Stored, store, table
from .names import all_words, folded, marks_of, person_parts, person_words, school_words, with_person_scores, with_school_scores
from .variants import similar_words, star_clusters, tune_bands, words_in_scopes

#: Least q-gram similarity of words that banding must not miss, and the share of such pairs it must find: schools have
#: one own name of two words; persons have two words or more, each of which makes the person a candidate, as do
#: neighbouring words run together. Those of persons have no use while words_in_scopes compares all pairs.
SCHOOL_JACCARD, SCHOOL_RECALL, SCHOOL_HASHES = 0.6, 0.985, 128
PERSON_JACCARD, PERSON_RECALL = 0.5, 0.95
#: Least edit similarity of two words that make a candidate, and least Monge-Elkan scores of a link.
LEAST_WORD = 0.6
LEAST_SCHOOL, LEAST_PERSON = 0.78, 0.76
#: A score is a mean of word similarities, so it needs one word that is as similar; only an initial's 0.9 can lift a mean
#: above all edit similarities, so words of names with an initial are compared down to LEAST_WORD, all others to this.
LEAST_PLAIN_WORD = LEAST_PERSON
#: Letters that begin a word and a longer form of it.
STEM = 5
#: The lead over another person that a link needs.
LEAD = 0.02
UNRESOLVED = "unknown-school:%"


def school_edges(spellings: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, node) of the spelled schools, and scored (node, school_id, score, label) with listed ones that may be meant."""
    bands, rows = tune_bands(SCHOOL_JACCARD, SCHOOL_RECALL, SCHOOL_HASHES)
    stored = store(school_words(folded(spellings.select("value").unionByName(listed.select(F.col("name").alias("value"))), "value")), "school-nodes")
    nodes = stored.df.where("node <> '' AND substring(node, 1, 1) <> ' '")  # behind the writing, which would compute the words twice
    core = F.element_at(F.split("node", " "), 1)
    marks = lambda c: F.struct(*[m.alias(n) for m, n in zip(marks_of(F.split(c, " ")), ("places", "kinds"))])
    centres = store(listed.join(nodes, listed["name"] == nodes["value"]).groupBy("node").agg(F.min("school_id").alias("school_id")).select(F.col("node").alias("label"), "school_id", core.alias("r"), marks("node").alias("label_marks")), "school-centres")
    asked = store(nodes.join(spellings.select("value").distinct(), "value", "left_semi"), "asked-schools").df
    stored.drop()
    kinds = store(asked.select("node").distinct().select("node", core.alias("l"), marks("node").alias("marks")), "school-kinds")
    scope = F.lit(0).alias("scope")
    near = similar_words(kinds.df.select(scope, F.col("l").alias("word")).distinct(), centres.df.select(scope, F.col("r").alias("word")).distinct(), bands, rows, LEAST_WORD)
    pairs = kinds.df.join(near.df.select("l", "r"), "l").join(centres.df, "r")
    edges = store(with_school_scores(pairs, "node", "marks", "label", "label_marks").select("node", "school_id", "score", "label"), "school-edges").df.where(F.col("score") >= LEAST_SCHOOL)
    for done in (near, centres, kinds):
        done.drop()
    return asked, edges


def link_schools(spellings: DataFrame, listed: DataFrame) -> DataFrame:
    """(value, school_id, score): spelled schools and the listed school each means; listed is (name, school_id)."""
    asked, edges = school_edges(spellings, listed)
    return asked.join(star_clusters(edges, "node", "school_id", "score", "label"), "node").select("value", "school_id", "score")


def star_centres(edges: DataFrame) -> DataFrame:
    """(node, centre) of edges (node, label) among the same nodes, loops included: star clustering.

    Nodes of more neighbours come first, then by a hash of the name. In that order a node next to no centre becomes one;
    every other node belongs to the first centre next to it. All nodes that come first among their undecided neighbours
    are decided in one round, so there are few rounds, whatever the order of the names.
    """
    both = store(edges.unionByName(edges.select(F.col("label").alias("node"), F.col("node").alias("label"))).distinct(), "star-graph")
    degree = both.df.groupBy("node").agg(F.count(F.lit(1)).alias("_d"))
    ranks = store(degree.select("node", F.struct((-F.col("_d")).alias("d"), F.xxhash64("node").alias("h"), F.col("node").alias("n")).alias("_rank")), "star-ranks")
    of = lambda name: ranks.df.select(F.col("node").alias(name), F.col("_rank").alias(f"_{name}"))
    graph = store(both.df.join(of("node"), "node").join(of("label"), "label").select("node", "label", "_node", "_label"), "star-graph")
    both.drop()
    rest, done = graph, []
    while not rest.df.isEmpty():
        first = rest.df.groupBy("node").agg(F.min("_label").alias("_least"), F.first("_node").alias("_own")).where("_least = _own").select("node")
        done.append(store(first, "star-centres"))
        gone = rest.df.join(done[-1].df.withColumnRenamed("node", "label"), "label", "left_semi").select("node").distinct()
        left = rest.df.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "label"), "label", "left_anti")
        old, rest = rest, store(left.select("node", "label", "_node", "_label"), "star-graph")
        if old is not graph:
            old.drop()
    if rest is not graph:
        rest.drop()
    if not done:
        return edges.select("node", F.col("label").alias("centre"))
    centres = reduce(DataFrame.unionByName, [d.df for d in done]).withColumnRenamed("node", "label")
    joined = store(graph.df.join(centres, "label").groupBy("node").agg(F.min("_label").alias("_c")).select("node", F.col("_c.n").alias("centre")), "star-joined")
    for d in (*done, graph, ranks):
        d.drop()
    return joined.df


def school_scopes(spellings: DataFrame, listed: DataFrame, unresolved: DataFrame) -> tuple[Stored, DataFrame]:
    """Stored (value, school_id) of the spelled schools that mean a listed one, and (value, scope) of these and of the others.

    unresolved (value) are schools as competitors without a listed school spell them. Those that mean no listed school
    become centres of scopes of their own, so that persons are looked for there too.
    """
    own = unresolved.join(listed.select(F.col("name").alias("value")), "value", "left_anti")
    asked, edges = school_edges(spellings, listed.unionByName(own.select(F.col("value").alias("name"), F.lit(None).cast("string").alias("school_id")).distinct()))
    nodes = store(star_clusters(edges.where("school_id IS NOT NULL"), "node", "school_id", "score", "label").select("node", "school_id"), "school-links").df
    links = store(asked.join(nodes, "node").select("value", "school_id"), "schools")
    rest = edges.where("school_id IS NULL").join(nodes, "node", "left_anti")
    new = asked.join(unresolved, "value", "left_semi").select("node").distinct().join(nodes, "node", "left_anti")
    among = rest.join(new, "node", "left_semi").join(new.select(F.col("node").alias("label")), "label", "left_semi").select("node", "label")
    members = star_centres(among).select(F.col("node").alias("label"), "centre")
    placed = star_clusters(rest.join(members, "label").select("node", F.concat(F.lit("school spelled "), "centre").alias("scope"), "score", F.col("centre").alias("label")), "node", "scope", "score", "label")
    return links, links.df.select("value", F.col("school_id").alias("scope")).unionByName(asked.join(placed, "node").select("value", "scope"))


def link_persons(spellings: DataFrame, listed: DataFrame) -> DataFrame:
    """(value, scope, entity_id, score): spelled names within a school; spellings (value, scope), listed (name, scope, entity_id)."""
    bands, rows = tune_bands(PERSON_JACCARD, PERSON_RECALL)
    stored = store(person_words(folded(spellings.select("value").unionByName(listed.select(F.col("name").alias("value"))), "value")), "person-names")
    names = stored.df.where("person <> ''")  # behind the writing, which would compute the words twice
    key = F.xxhash64("scope", "person")
    people = listed.join(names, listed["name"] == names["value"]).groupBy("scope", "person").agg(F.min("entity_id").alias("entity_id"))
    people = store(people.select(key.alias("_cid"), "scope", F.col("person").alias("label"), "entity_id", person_parts(F.col("person")).alias("listed_parts")).withColumn("words", all_words(F.col("listed_parts"))), "people")
    asked = store(spellings.distinct().join(names, "value").select("value", "scope", "person", key.alias("_rid")), "asked").df
    stored.drop()
    kinds = store(asked.select("_rid", "scope", "person").distinct().withColumn("parts", person_parts(F.col("person"))).withColumn("words", all_words(F.col("parts"))), "kinds")
    initial = lambda name: F.col(name).rlike(r"(^| ).( |$)")
    long = lambda df, key, person, name: df.select(key, "scope", initial(person).alias("weak"), F.explode("words").alias(name)).where(f"length({name}) >= 2")
    left, right = long(kinds.df, "_rid", "person", "l"), long(people.df, "_cid", "label", "r")
    distinct = lambda side, name: side.groupBy("scope", F.col(name).alias("word")).agg(F.bool_or("weak").alias("weak"))
    words, listed_words = store(distinct(left, "l"), "person-words"), store(distinct(right, "r"), "listed-words")
    near = words_in_scopes(words.df, listed_words.df, bands, rows, LEAST_WORD, LEAST_PLAIN_WORD)
    stem = lambda side, name: side.where(F.length("word") >= STEM).select("scope", F.substring("word", 1, STEM).alias("_stem"), F.col("word").alias(name))
    begins = stem(words.df, "l").join(stem(listed_words.df, "r"), ["scope", "_stem"]).where("l <> r AND (startswith(l, r) OR startswith(r, l))").select("scope", "l", "r")
    pairs = left.drop("weak").join(reduce(DataFrame.unionByName, [n.df for n in near]).unionByName(begins), ["scope", "l"]).join(right.drop("weak"), ["scope", "r"]).select("_rid", "_cid").distinct()
    full = pairs.join(kinds.df.select("_rid", "person", "parts"), "_rid").join(people.df.drop("scope", "words"), "_cid")
    scored = store(with_person_scores(full, "person", "parts", "label", "listed_parts").select("_rid", "entity_id", "score", "label"), "person-scores")
    linked = star_clusters(scored.df.where(F.col("score") >= LEAST_PERSON), "_rid", "entity_id", "score", "label", LEAD)
    for done in (*near, kinds, people, words, listed_words):
        done.drop()
    return asked.join(linked, "_rid").select("value", "scope", "entity_id", "score")


def link_rows(results: DataFrame, competitors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, entity_id) of result rows, (competitor_id, school_id) of unresolved competitors)."""
    known = F.col("canonical_school_id").isNotNull() & ~F.col("canonical_school_id").like(UNRESOLVED)
    listed = competitors.where(known & F.col("canonical_school_name").isNotNull()).select(F.col("canonical_school_name").alias("name"), F.col("canonical_school_id").alias("school_id")).distinct()
    open_ones = competitors.where(~known).select("competitor_id", "display_name", F.col("display_school").alias("value"))
    spelled = results.select(F.col("published_school").alias("value")).unionByName(open_ones.select("value")).where("value IS NOT NULL").distinct()
    spelled = store(spelled, "spelled-schools").df
    schools, scopes = school_scopes(spelled, listed, open_ones.select("value").where("value IS NOT NULL").distinct())
    scopes = store(scopes, "school-scopes")
    resolved = open_ones.join(schools.df, "value").select("competitor_id", "school_id").distinct()
    people = competitors.where(known).select("display_name", "canonical_school_id", "competitor_id").toDF("name", "scope", "entity_id").unionByName(open_ones.join(scopes.df, "value").select("display_name", "scope", "competitor_id").toDF("name", "scope", "entity_id"))
    people = people.where("name IS NOT NULL AND entity_id IS NOT NULL").distinct()
    asked = store(results.join(scopes.df, results["published_school"] == scopes.df["value"]).select("id", F.col("published_name").alias("value"), scopes.df["scope"]).where("value IS NOT NULL"), "asked-rows")
    persons = link_persons(asked.df.select("value", "scope"), people)
    return asked.df.join(persons, ["value", "scope"]).select("id", "entity_id").distinct(), resolved


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "results").where("source_person_key IS NULL AND id IS NOT NULL").select("id", "published_name", "published_school")
    competitors = table(spark, sf_dir, "competitors").select("competitor_id", "display_name", "display_school", "canonical_school_id", "canonical_school_name")
    persons, schools = link_rows(results, competitors)
    return persons.select(F.lit("person").alias("record_kind"), F.col("id").alias("record_id"), "entity_id").unionByName(schools.select(F.lit("school").alias("record_kind"), F.col("competitor_id").alias("record_id"), F.col("school_id").alias("entity_id")))


def typed_schools(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """((value) of every school as somebody typed it in results, competitors and aliases, (name, school_id) of the listed ones)."""
    competitors, results = table(spark, sf_dir, "competitors"), table(spark, sf_dir, "results")
    listed = competitors.where(~F.col("canonical_school_id").like(UNRESOLVED)).select(F.col("canonical_school_name").alias("name"), F.col("canonical_school_id").alias("school_id")).where("name IS NOT NULL").distinct()
    return results.select(F.col("published_school").alias("value")).unionByName(competitors.select(F.explode(F.array("display_school", "matched_alias")).alias("value"))).where("value IS NOT NULL").distinct(), listed


def p4_schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every school as somebody typed it with the listed school it means."""
    typed, listed = typed_schools(spark, sf_dir)
    return link_schools(store(typed, "typed-schools").df, listed).select("value", "school_id", F.round("score", 6).alias("score"))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every school as somebody typed it in its star cluster, and how many spellings that holds.

    The centre is the listed school that the spelling means; spellings that mean none are clustered among themselves, the
    centre being the one that most others are like.
    """
    typed, listed = typed_schools(spark, sf_dir)
    typed = store(typed, "typed-schools").df
    linked = store(link_schools(typed, listed).select("value", F.col("school_id").alias("cluster")), "linked-schools").df
    rest = store(typed.join(linked, "value", "left_anti"), "unlisted-schools").df
    asked, edges = school_edges(rest, rest.select(F.col("value").alias("name"), F.lit(None).cast("string").alias("school_id")))
    own = asked.join(star_centres(edges.select("node", "label")), "node").select("value", F.concat(F.lit("spelled "), "centre").alias("cluster"))
    members = store(linked.unionByName(own), "school-clusters").df
    return members.join(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("spellings")), "cluster").select("value", "cluster", "spellings")


QUERIES = {"p4_found": p4_found, "p4_schools": p4_schools, "p4_clusters": p4_clusters}
ORACLE: dict[str, str] = {}
