"""Nested references against a search over all entities of all classes, existing and new."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from tablemend.operators.link import LinkModel, name_prior
from tablemend.plans import catalog, fixtures
from tablemend.plans.nested import Nested, Prior, clean_nested, link_nested

COUNTY = Nested("County", ("county",))
OWNER = Nested("Owner", ("owner", "kind"))
PLACE = Nested("Place", ("city",), (COUNTY,))
SITE = Nested("Site", ("site", "phone"), (PLACE, OWNER))


def distance(cache={}):
    def of(a, b):
        if (a, b) not in cache:
            cache[a, b] = duckdb.execute("SELECT damerau_levenshtein(?, ?)", [a, b]).fetchone()[0]
        return cache[a, b]

    return of


def typo(k, word):
    if k > 2:
        return -1e5
    r = math.ceil(len(word) / 5)
    return math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(0.9) + k * (math.log(0.1) - math.log(len(word)) - math.log(26) / 2)


def brute(cls, row, tables, logp, far, p=Prior()):
    """(score, is_new, id, {class: id}) of the best entity, and each entity's fit."""
    below = [brute(r, row, tables, logp, far, p) for r in cls.refs]
    total, options, fits = sum(e["n"] for e in tables[cls.name]), [], {}
    for e in tables[cls.name]:
        fit = sum(0.0 if row[a] is None else typo(far(row[a], e[a]), e[a]) if e[a] is not None else -1e5 for a in cls.attributes)
        fit += sum(b[1][e[r.id]][0] for r, b in zip(cls.refs, below))
        ids = {cls.name: e["entity_id"]}
        for r, b in zip(cls.refs, below):
            ids |= b[1][e[r.id]][1]
        fits[e["entity_id"]] = fit, ids
        options.append((-round(math.log(e["n"] - p.discount) - math.log(total + p.strength) + fit, 6), False, e["entity_id"], ids))
    new = math.log(len(tables[cls.name]) * p.discount + p.strength) - math.log(total + p.strength)
    new += sum(0.0 if row[a] is None else logp[a, row[a]] + typo(0, row[a]) for a in cls.attributes) - sum(b[0][0] for b in below)
    ids = {cls.name: None}
    for b in below:
        ids |= b[0][3]
    options.append((-round(new, 6), True, "", ids))
    return min(options, key=lambda o: o[:3]), fits


def test_joint_decision(spark):
    rng, far = random.Random(11), distance()

    def word(n=7):
        return "".join(rng.choice("abcdefgh") for _ in range(n))

    def spoil(w):
        roll = rng.random()
        if roll < 0.2:
            return None
        if roll < 0.3:
            return word()
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(w))
            w = w[:at] + rng.choice("abcdefgh") + w[at + 1 :]
        return w

    tables = {"County": [{"entity_id": f"c{i}", "county": word(), "n": rng.randint(1, 90)} for i in range(4)]}
    tables["Owner"] = [{"entity_id": f"o{i}", "owner": word(), "kind": rng.choice(["public", "private", None]), "n": rng.randint(1, 50)} for i in range(3)]
    cities = [word() for _ in range(6)]
    tables["Place"] = [{"entity_id": f"p{i}", "city": cities[i % 6], "County_id": rng.choice(tables["County"])["entity_id"], "n": rng.randint(1, 50)} for i in range(9)]
    tables["Site"] = [
        {"entity_id": f"s{i:02}", "site": word(), "phone": word(9), "Place_id": rng.choice(tables["Place"])["entity_id"], "Owner_id": rng.choice(tables["Owner"])["entity_id"], "n": rng.randint(1, 9)} for i in range(30)
    ]
    by_id = {e["entity_id"]: e for t in tables.values() for e in t}
    rows = []
    for _ in range(200):
        s = by_id[rng.choice(tables["Site"])["entity_id"]]
        place, owner = by_id[s["Place_id"]], by_id[s["Owner_id"]]
        clean = {"site": s["site"], "phone": s["phone"], "city": place["city"], "county": by_id[place["County_id"]]["county"], "owner": owner["owner"], "kind": owner["kind"] or "public"}
        if rng.random() < 0.15:
            clean |= {"site": word(), "phone": word(9)}
        rows.append({c: spoil(v) for c, v in clean.items()})
    rows.append(dict.fromkeys(SITE.columns()))
    distinct = [dict(zip(SITE.columns(), v)) for v in {tuple(r[c] for c in SITE.columns()) for r in rows}]
    tups = spark.createDataFrame([(*[r[c] for c in SITE.columns()], 1 + k % 3) for k, r in enumerate(distinct)], ", ".join(f"{c} string" for c in SITE.columns()) + ", c long")
    logp = {(a, r.word): r.logp for a in SITE.columns() for r in name_prior(tups.groupBy(a).agg(F.sum("c").alias("c")), LinkModel(a)).collect()}
    kinds = {"County": "entity_id string, county string, n long", "Owner": "entity_id string, owner string, kind string, n long", "Place": "entity_id string, city string, County_id string, n long", "Site": "entity_id string, site string, phone string, Place_id string, Owner_id string, n long"}
    frames = {c: spark.createDataFrame([tuple(e[x.split()[0]] for x in kinds[c].split(", ")) for e in t], kinds[c]) for c, t in tables.items()}
    got = {tuple(r[c] for c in SITE.columns()): r for r in link_nested(tups, SITE, frames).collect()}
    assert len(got) == len(distinct)
    news = through_refs = 0
    for r in distinct:
        (score, is_new, _, ids), _ = brute(SITE, r, tables, logp, far)
        g = got[tuple(r[c] for c in SITE.columns())]
        assert abs(g.score + score) < 1e-4 and g.is_new == is_new, (r, g)
        for name, own in ids.items():
            assert own is None or g[f"{name}_id"] == own, (r, g, ids)
        news += is_new
        site = by_id.get(g.Site_id)
        through_refs += bool(site) and all(r[a] is None or far(r[a], site[a]) > 2 for a in SITE.attributes)
    assert news > 5 and through_refs > 5


def test_lost_cells_come_back(spark, sf):
    dirty = fixtures.markets_dirty(spark, sf)
    out = clean_nested(dirty.select("row_id", "segment", "nation", "region", F.lit(1).alias("note")), catalog.MARKET)
    both = out.flat.select("row_id", *[F.col(c).alias(f"got_{c}") for c in ("segment", "nation", "region")]).join(dirty, "row_id")
    n = dirty.count()
    assert both.count() == n and out.flat.columns == ["row_id", "segment", "nation", "region", "note"]
    for c, gain in (("segment", 0.05), ("nation", 0.05), ("region", 0.2)):
        right, before = both.select(F.avg((F.col(f"got_{c}") == F.col(f"true_{c}")).cast("int")), F.avg(F.coalesce(F.col(c) == F.col(f"true_{c}"), F.lit(False)).cast("int"))).first()
        assert right >= before + gain
    market, nation = out.tables["Market"], out.tables["Nation"]
    assert market.select(F.sum("n")).first()[0] == nation.select(F.sum("n")).first()[0] == n
    assert market.join(nation, market.Nation_id == nation.entity_id, "left_anti").count() == 0


def test_empty_and_missing(spark):
    cls = Nested("Nation", ("nation",), (Nested("Region", ("region",)),))
    empty = spark.createDataFrame([], "row_id string, nation string, region string")
    assert clean_nested(empty, cls).flat.collect() == []
    rows = [("1", None, None), ("2", None, None), ("3", "norway", "europe"), ("4", "norway", "europe"), ("5", "norwya", None)]
    out = clean_nested(spark.createDataFrame(rows, empty.schema), cls)
    assert {r.row_id: (r.nation, r.region) for r in out.flat.collect()}["5"] == ("norway", "europe")
    assert out.links.count() == 5
