"""The catalogue's results stated as SQL for an independent engine.

Shared pieces (draws, fixtures, likelihoods) are text templates; every query is one
WITH statement over the given tables.
"""

from __future__ import annotations

from collections.abc import Sequence

ORACLES: dict[str, str] = {}

S, D = "1.0e0", "0.25e0"  # entity-count prior used by the linking queries
LN09, LN01 = "ln(0.9e0)", "ln(1.0e0-0.9e0)"
FLOOR = "-1.0e9"


def u(tag: str, key: str = "row_id") -> str:
    return f"(((('0x' || substr(md5('7|{tag}|' || {key}), 1, 8))::BIGINT)::DOUBLE + 0.5e0) / 4294967296.0e0)"


def ident(*parts: str) -> str:
    """The id of a business key."""
    return "md5(" + " || ".join(f"coalesce(length({p}::VARCHAR) || ':' || {p}::VARCHAR, '~')" for p in parts) + ")"


def r(x: str, digits: int = 6) -> str:
    return f"(CASE WHEN abs({x}) < {0.5 * 10 ** -digits:.1e} THEN 0.0e0 ELSE round({x}, {digits}) END)"


def norm(x: str, mean: str, std: str) -> str:
    return f"(-0.5e0 * (({x} - {mean}) / {std}) * (({x} - {mean}) / {std}) - ln({std}) - 0.5e0 * ln(2.0e0 * pi()))"


def typo_loglik(k: str, word: str) -> str:
    size = f"length({word})::DOUBLE"
    rr = f"ceil({size} / 5.0e0)"
    return (
        f"(CASE WHEN {k} = 0 THEN {rr} * {LN09} WHEN length({word}) = 0 THEN -1.0e5 ELSE lgamma({k} + {rr}) - lgamma({rr}) - lgamma({k} + 1.0e0) + {rr} * {LN09} + {k} * {LN01}"
        f" - {k} * ln({size}) - {k} * ln(26.0e0) / 2.0e0 END)"
    )




# --- fixtures ---------------------------------------------------------------------------

LINE_ID = ident("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "(l_shipdate::DATE - DATE '1970-01-01')")

CLAIMS = f"""
opts AS (SELECT option, row_number() OVER (ORDER BY md5(option), option) AS idx, count(*) OVER () AS n_options
         FROM (SELECT DISTINCT p_type AS option FROM part WHERE p_type IS NOT NULL)),
claims0 AS (SELECT {LINE_ID} AS row_id, l_partkey AS part, l_suppkey AS source, p_type AS truth
            FROM lineitem JOIN part ON p_partkey = l_partkey),
claims AS (SELECT row_id, part, source, truth,
             CASE WHEN {u('swap.truth')} < 0.05e0 + 0.4e0 * {u('rate', 'source')} THEN option ELSE truth END AS claim
           FROM claims0 JOIN opts ON idx = floor({u('pick.truth')} * (SELECT max(n_options) FROM opts)) + 1)"""

PRICES = f"""
prices0 AS (SELECT {LINE_ID} AS row_id, l_partkey AS part, p_retailprice AS truth FROM lineitem JOIN part ON p_partkey = l_partkey),
prices1 AS (SELECT *, round(truth + 10.0e0 * sqrt(-2.0e0 * ln({u('noise.truth.r')})) * cos(2.0e0 * pi() * {u('noise.truth.a')}), 2) AS noisy FROM prices0),
prices AS (SELECT *, CASE WHEN {u('unit.noisy')} < 0.2e0 THEN round(noisy * 0.001e0, 5) ELSE noisy END AS shown FROM prices1)"""


def typo_steps(src: str, column: str, out: str, name: str, max_typos: int = 2) -> str:
    """CTEs that add ``out``: ``column`` mistyped."""
    tag = f"typo.{column}"
    mass, below = f"pow(0.9e0, ceil(length({column}) / 5.0e0))", ""
    conds = []
    total = mass
    for k in range(max_typos):
        conds.append(f"(CASE WHEN {u(tag)} >= {total} THEN 1 ELSE 0 END)")
        mass = f"({mass} * (ceil(length({column}) / 5.0e0) + {k}) * {(1 - 0.9) / (k + 1)!r}e0)"
        total = f"({total} + {mass})"
    sql = f"{name}_0 AS (SELECT *, {' + '.join(conds)} AS _n, {column} AS _w FROM {src})"
    for i in range(max_typos):
        t = f"{tag}.{i}"
        place = "(floor(_at * _l)::INT + 1)"
        pair = "(floor(_at * (_l - 1))::INT + 1)"
        gap = "(floor(_at * (_l + 1))::INT)"
        sql += f""",
{name}_{i}d AS (SELECT *, length(_w) AS _l, floor({u(t + '.kind')} * 4) AS _kind, {u(t + '.at')} AS _at,
   substr('abcdefghijklmnopqrstuvwxyz', floor({u(t + '.letter')} * 26)::INT + 1, 1) AS _c FROM {name}_{i}),
{name}_{i + 1} AS (SELECT * EXCLUDE (_l, _kind, _at, _c) REPLACE (CASE WHEN _n <= {i} THEN _w
   WHEN _kind = 0 THEN substr(_w, 1, {gap}) || _c || substr(_w, {gap} + 1)
   WHEN _l = 0 THEN _w
   WHEN _kind = 1 THEN substr(_w, 1, {place} - 1) || substr(_w, {place} + 1)
   WHEN _kind = 2 AND _l > 1 THEN substr(_w, 1, {pair} - 1) || substr(_w, {pair} + 1, 1) || substr(_w, {pair}, 1) || substr(_w, {pair} + 2)
   WHEN _kind = 2 THEN _w
   ELSE substr(_w, 1, {place} - 1) || _c || substr(_w, {place} + 1) END AS _w) FROM {name}_{i}d)"""
    return sql + f",\n{name} AS (SELECT * EXCLUDE (_n, _w), _w AS {out} FROM {name}_{max_typos})"


PARTS = f"""
parts0 AS (SELECT {ident('p_partkey')} AS row_id, p_name AS p_name, p_type, p_brand FROM part),
{typo_steps('parts0', 'p_name', 'dirty_name', 'parts1')},
parts AS (SELECT row_id, dirty_name AS p_name, CASE WHEN {u('missing.p_type')} >= 0.15e0 THEN p_type END AS p_type, p_brand,
            p_name AS clean_name, p_type AS clean_type FROM parts1)"""

FLAT = f"""
flat0 AS (SELECT {ident('c_custkey')} AS row_id, c_name, c_mktsegment AS true_segment, n_name AS true_nation, r_name AS true_region
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
{typo_steps('flat0', 'true_segment', 'segment', 'flat1')},
{typo_steps('flat1', 'true_nation', 'nation', 'flat2')},
flat AS (SELECT *, CASE WHEN {u('missing.true_region')} >= 0.1e0 THEN true_region END AS region FROM flat2)"""

NAMES = f"""
names0 AS (SELECT {ident('p_partkey')} AS row_id, split_part(p_name, ' ', 1) AS first, p_type AS middle, split_part(p_name, ' ', 2) AS last FROM part),
names1 AS (SELECT *, CASE WHEN {u('form.first')} < 0.1e0 THEN first[1] || '.' ELSE first END AS f,
             CASE WHEN {u('form.middle')} < 0.1e0 THEN middle[1] || '.' ELSE middle END AS m FROM names0),
names AS (SELECT row_id, first, middle, last, CASE WHEN middle IS NULL OR middle = '' OR {u('form.drop')} < 0.1e0
            THEN f || ' ' || last ELSE f || ' ' || m || ' ' || last END AS shown FROM names1)"""

NAMES_MISSING = NAMES + f""",
shown AS (SELECT * REPLACE (CASE WHEN {u('missing.shown')} >= 0.1e0 THEN shown END AS shown) FROM names)"""

TIMES = f"""
times0 AS (SELECT {ident('event_id')} AS row_id,
   (CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END)::VARCHAR || ':' || lpad(minute(ts)::VARCHAR, 2, '0')
   || CASE WHEN hour(ts) < 12 THEN ' a.m.' ELSE ' p.m.' END AS t FROM events),
times AS (SELECT row_id, CASE WHEN {u('malformed')} < 0.05e0 THEN replace(t, '.', '')
   WHEN {u('malformed')} < 0.1e0 THEN replace(t, ':', '.') ELSE t END AS time_text FROM times0)"""

TIME_OK = r"regexp_full_match(%s, '\d?\d:\d\d [ap]\.m\.')"


def steps(name: str, src: str, text: str, keep: str = "") -> str:
    """CTE of letter steps (prev, next) of each text."""
    k = f"{keep}, " if keep else ""
    return f"""{name}_l AS (SELECT {k}string_split(regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z .]', '#', 'g'), '') AS l
   FROM {src} WHERE length({text}) > 0),
{name}_s AS (SELECT {k}unnest(list_concat(['^'], l[1:len(l) - 1])) AS prev, unnest(l) AS next FROM {name}_l),
{name} AS (SELECT {k}CASE WHEN prev = '#' THEN '^' ELSE prev END AS prev, next FROM {name}_s)"""


def bigrams(name: str, src: str, text: str, weight: str = "") -> str:
    n = f"sum({weight})" if weight else "count(*)"
    return f"""{steps(name + '_st', src, text, weight)},
{name}_c AS (SELECT prev, next, {n} AS n FROM {name}_st WHERE next <> '#' GROUP BY prev, next),
{name}_a AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz .', '')) AS next),
{name}_p AS (SELECT '^' AS prev UNION ALL SELECT next FROM {name}_a),
{name}_g AS (SELECT p.prev, a.next, coalesce(c.n, 0)::BIGINT AS n FROM {name}_p p CROSS JOIN {name}_a a LEFT JOIN {name}_c c ON c.prev = p.prev AND c.next = a.next),
{name} AS (SELECT prev, next, n, (n + 1)::DOUBLE / (sum(n) OVER (PARTITION BY prev) + 28)::DOUBLE AS p FROM {name}_g)"""


def text_prior(name: str, words: str, letters: str, lo: int = 3, hi: int = 30, tails: bool = False) -> str:
    """CTE (word, logp) for the distinct ``word`` column of ``words``."""
    size = f"-ln({hi - lo + 1}.0e0) + coalesce(s, 0.0e0)"
    other = f"{size} - ln(2.0e0) * greatest({lo} - length(w.word), length(w.word) - {hi})" if tails else FLOOR
    return f"""{steps(name + '_st', words, 'word', 'word')},
{name}_s AS (SELECT word, sum(CASE WHEN st.next = '#' THEN -ln(28.0e0) ELSE greatest(ln(b.p), -1000.0e0) END) AS s
   FROM {name}_st st LEFT JOIN {letters} b ON b.prev = st.prev AND b.next = st.next GROUP BY word),
{name} AS (SELECT w.word, CASE WHEN length(w.word) BETWEEN {lo} AND {hi} THEN {size} ELSE {other} END AS logp
   FROM {words} w LEFT JOIN {name}_s USING (word))"""


TEXTS = "texts AS (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)"

# part/option evidence of claims at a fixed rate, as the plain product of claims and options
OPTION_SCORES = CLAIMS + """,
cnt AS (SELECT part, claim AS option, count(*) AS n FROM claims WHERE claim IS NOT NULL GROUP BY ALL),
siz AS (SELECT part, count(*)::DOUBLE AS m FROM cnt GROUP BY part),
scores AS (SELECT o.part, o.option, sum(c.n * CASE WHEN c.option = o.option THEN ln(1.0e0 - 0.1e0) ELSE ln(0.1e0) - ln(m) END) - any_value(ln(m)) AS score
   FROM cnt o JOIN cnt c ON c.part = o.part JOIN siz s ON s.part = o.part GROUP BY o.part, o.option)"""
TOTALS = OPTION_SCORES + """,
tops AS (SELECT part, max(score) AS mx FROM scores GROUP BY part),
lse AS (SELECT part, any_value(mx) + ln(sum(exp(score - mx))) AS lse FROM scores JOIN tops USING (part) GROUP BY part)"""

TUPLES = "tup AS (SELECT nation, region, count(*) AS c FROM flat GROUP BY ALL)"
NATIONS = f"""ents AS (SELECT {ident('n_name', 'r_name')} AS entity_id, n_name AS nation, r_name AS region, cc.n
   FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT nation, count(*) AS n FROM flat GROUP BY nation) cc ON cc.nation = n_name)"""


def candidates(name: str, tup: str, ents: str, k: int = 2) -> str:
    return f"""{name}_k AS (SELECT t.nation, t.region, t.c, e.entity_id, e.nation AS e_nation, e.region AS e_region, e.n, damerau_levenshtein(t.nation, e.nation) AS k
   FROM {tup} t JOIN {ents} e ON t.region IS NULL OR t.region = e.region),
{name} AS (SELECT *, ln(n - {D}) - ln((SELECT sum(n) FROM {ents})::DOUBLE + {S}) + {typo_loglik('k', 'e_nation')} AS score FROM {name}_k WHERE k <= {k})"""


def best(name: str, src: str, keys: str, score: str = "score", tie: str = "entity_id") -> str:
    return f"""{name} AS (SELECT * EXCLUDE _rn FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round({score}, 6) DESC, {tie}) AS _rn FROM {src}) WHERE _rn = 1)"""


CAND = f"{FLAT},\n{TUPLES},\n{NATIONS},\n{candidates('cand', 'tup', 'ents')}"
OWN_ID = ident("coalesce({0}nation, '')", "coalesce({0}region, '')")
SAME = "{0}.nation IS NOT DISTINCT FROM {1}.nation AND {0}.region IS NOT DISTINCT FROM {1}.region"


def linked(name: str, tup: str, ents: str, k: int = 2) -> str:
    """CTE: each tuple's best entity, or itself as a new one."""
    return f"""{candidates(name + '_c', tup, ents, k)},
{best(name + '_b', name + '_c', 'nation, region')},
{name} AS (SELECT t.nation, t.region, t.c, coalesce(b.entity_id, {OWN_ID.format('t.')}) AS entity_id, b.entity_id IS NULL AS is_new
   FROM {tup} t LEFT JOIN {name}_b b ON {SAME.format('t', 'b')})"""


def seeds(name: str, tup: str, column: str = "nation", exact: str = "region", lo: int = 3) -> str:
    """CTE: tuples that stand for entities of their own."""
    e = f"AND w.{exact} = v.{exact}" if exact else ""
    fields = f"{column}, {exact}" if exact else column
    known = f"{column} IS NOT NULL" + (f" AND {exact} IS NOT NULL" if exact else "")
    own_id = ident(column, exact) if exact else ident(column)
    region = f"- ln((SELECT count(DISTINCT {exact}) FROM {name}_s)::DOUBLE)" if exact else ""
    return f"""{name}_w AS (SELECT {column} AS word, sum(c)::BIGINT AS c FROM {tup} WHERE {column} IS NOT NULL GROUP BY {column}),
{bigrams(name + '_bg', name + '_w', 'word', 'c')},
{text_prior(name + '_tp', name + '_w', name + '_bg', lo, tails=True)},
{name}_s AS (SELECT {own_id} AS entity_id, {fields}, c AS n FROM {tup} WHERE {known}),
{name}_own AS (SELECT s.*, ln((SELECT count(*) FROM {name}_s) * {D} + {S}) + logp {region} + n * {typo_loglik('0', column)}
     + lgamma(n - {D}) - lgamma(1.0e0 - {D}) AS own FROM {name}_s s JOIN {name}_tp t ON t.word = s.{column}),
{name}_j AS (SELECT w.entity_id, max(w.n * {typo_loglik(f'damerau_levenshtein(w.{column}, v.{column})', f'v.{column}')} + lgamma(v.n + w.n - {D}) - lgamma(v.n - {D})) AS j
   FROM {name}_s w JOIN {name}_s v ON damerau_levenshtein(w.{column}, v.{column}) BETWEEN 1 AND 2 {e}
     AND (v.n > w.n OR (v.n = w.n AND v.entity_id < w.entity_id)) GROUP BY w.entity_id),
{name} AS (SELECT o.entity_id, {', '.join('o.' + f.strip() for f in fields.split(','))}, o.n FROM {name}_own o LEFT JOIN {name}_j j USING (entity_id)
   WHERE j IS NULL OR round(own, 6) >= round(j, 6))"""


INITIAL = f"{FLAT},\n{TUPLES},\n{seeds('sd', 'tup')},\n{linked('l0', 'tup', 'sd')}"


def swept(i: int) -> str:
    """CTEs of sweep ``i``: links l{i} and entities e{i} from links l{i-1}."""
    p, n = f"l{i - 1}", f"x{i}"
    return f"""{n}_n AS (SELECT entity_id, nation, sum(c) AS c FROM {p} WHERE nation IS NOT NULL GROUP BY ALL),
{n}_v AS (SELECT o.entity_id, o.nation AS word, sum(v.c * CASE WHEN damerau_levenshtein(v.nation, o.nation) <= 2
      THEN {typo_loglik('damerau_levenshtein(v.nation, o.nation)', 'o.nation')} ELSE -1.0e5 END) AS score
   FROM {n}_n o JOIN {n}_n v USING (entity_id) GROUP BY ALL),
{best(n + '_name', n + '_v', 'entity_id', 'score', 'word')},
{n}_rv AS (SELECT entity_id, region, sum(c)::DOUBLE AS score FROM {p} WHERE region IS NOT NULL GROUP BY ALL),
{best(n + '_reg', n + '_rv', 'entity_id', 'score', 'region')},
{n}_sz AS (SELECT entity_id, sum(c)::BIGINT AS n FROM {p} GROUP BY entity_id),
{n}_e AS (SELECT {OWN_ID.format('')} AS entity_id, nation, region, sum(n)::BIGINT AS n
   FROM (SELECT a.word AS nation, b.region, z.n FROM {n}_name a LEFT JOIN {n}_reg b USING (entity_id) JOIN {n}_sz z USING (entity_id)) GROUP BY ALL),
{linked(f'l{i}', 'tup', n + '_e')},
e{i} AS (SELECT * FROM {n}_e WHERE entity_id IN (SELECT entity_id FROM l{i})),
fixed{i} AS (SELECT f.row_id, coalesce(e.nation, f.nation) AS nation, coalesce(e.region, f.region) AS region
   FROM flat f JOIN l{i} l ON {SAME.format('f', 'l')} LEFT JOIN e{i} e USING (entity_id))"""


SWEEP1 = f"{INITIAL},\n{swept(1)}"
SWEEP2 = f"{SWEEP1},\n{swept(2)}"


def column_repair(name: str, src: str, column: str) -> str:
    """CTE (row_id, repaired, score): typo repair of one column of ``src``."""
    return f"""{name}_t AS (SELECT {column}, count(*) AS c FROM {src} GROUP BY ALL),
{seeds(name + '_sd', name + '_t', column, '')},
{name}_k AS (SELECT t.{column} AS obs, v.entity_id, v.{column} AS word, v.n, damerau_levenshtein(t.{column}, v.{column}) AS k FROM {name}_t t JOIN {name}_sd v ON true),
{name}_c AS (SELECT *, ln(n - {D}) - ln((SELECT sum(n) FROM {name}_sd)::DOUBLE + {S}) + {typo_loglik('k', 'word')} AS score FROM {name}_k WHERE k <= 2),
{best(name + '_b', name + '_c', 'obs')},
{name} AS (SELECT s.row_id, coalesce(b.word, s.{column}) AS repaired, b.score FROM {src} s LEFT JOIN {name}_b b ON b.obs = s.{column})"""


IMPUTE = """seen AS (SELECT p_brand, p_type AS option, count(*) AS n FROM parts WHERE p_type IS NOT NULL GROUP BY ALL),
overall AS (SELECT option FROM (SELECT option, sum(n) AS n FROM seen GROUP BY option) ORDER BY n DESC, option LIMIT 1),
locals AS (SELECT p_brand, option FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, option) AS rn FROM seen) WHERE rn = 1),
imputed AS (SELECT row_id, coalesce(p_type, l.option, (SELECT option FROM overall)) AS p_type, p_type IS NULL AS was_missing
   FROM parts LEFT JOIN locals l USING (p_brand))"""

VERSIONS = f"""{PARTS},
{column_repair('rep', 'parts', 'p_name')},
{IMPUTE},
v AS (SELECT p.row_id, row_number() OVER (ORDER BY p.row_id) AS row_no, p.p_name AS d1, p.clean_name AS k1, r.repaired AS o1, p.p_type AS d2, p.clean_type AS k2, i.p_type AS o2
   FROM parts p JOIN rep r USING (row_id) JOIN imputed i USING (row_id)),
cells AS (SELECT row_id, row_no, 'p_name' AS col, d1 AS d, k1 AS k, o1 AS o FROM v UNION ALL SELECT row_id, row_no, 'p_type', d2, k2, o2 FROM v),
flags AS (SELECT *, (d IS NOT NULL AND d IS DISTINCT FROM k)::INT AS error, (d IS NOT NULL AND o IS DISTINCT FROM d)::INT AS changed,
   (d IS NOT NULL AND o IS DISTINCT FROM d AND o = k)::INT AS cleaned, (d IS NULL AND k IS NOT NULL)::INT AS imputed,
   (d IS NULL AND k IS NOT NULL AND coalesce(o = k, false))::INT AS right_imputed FROM cells)"""


def ratios(missing: str = "imputed") -> str:
    right = "(cleaned + correctly_imputed)::DOUBLE"
    p, q = f"({right} / nullif(changed + imputed, 0))", f"({right} / nullif(errors + {missing}, 0))"
    return f"{r(p)} AS precision, {r(q)} AS recall, {r(f'(2.0e0 / nullif(1.0e0 / nullif({p}, 0) + 1.0e0 / nullif({q}, 0), 0))')} AS f1"


EM_COUNTS = CLAIMS + ", cs AS (SELECT part, source, claim AS option, count(*) AS n FROM claims WHERE claim IS NOT NULL GROUP BY ALL)"


def em_round(i: int, owns: bool) -> str:
    """CTEs of one round: truth t{i} and rates r{i}."""
    rate = f"coalesce(p.rate, {10 / 60!r}e0)" if i else f"{10 / 60!r}e0"
    if owns:
        rate = f"CASE WHEN c.part % 100 = c.source THEN 1.0e-5 ELSE {rate} END"
    join = f"LEFT JOIN r{i - 1} p USING (source)" if i else ""
    skip = "WHERE NOT (c.part % 100 = c.source)" if owns else ""
    return f"""c{i} AS (SELECT c.part, c.source, c.option, c.n, {rate} AS rate FROM cs c {join}),
o{i} AS (SELECT part, option, count(*) OVER (PARTITION BY part)::DOUBLE AS m FROM (SELECT DISTINCT part, option FROM cs)),
s{i} AS (SELECT o.part, o.option, sum(c.n * CASE WHEN c.option = o.option THEN ln(1.0e0 - c.rate) ELSE ln(c.rate) - ln(o.m) END) - any_value(ln(o.m)) AS score
   FROM o{i} o JOIN c{i} c USING (part) GROUP BY o.part, o.option),
{best(f'b{i}', f's{i}', 'part', 'score', 'option')},
t{i} AS (SELECT b.part, b.option AS value, exp(b.score - (SELECT 0.0e0) - z.lse) AS posterior FROM b{i} b
   JOIN (SELECT s.part, any_value(m.mx) + ln(sum(exp(s.score - m.mx))) AS lse FROM s{i} s JOIN (SELECT part, max(score) AS mx FROM s{i} GROUP BY part) m USING (part) GROUP BY s.part) z USING (part)),
r{i} AS (SELECT source, errors, matches, (10.0e0 + errors) / (60.0e0 + errors + matches) AS rate FROM (
   SELECT c.source, coalesce(sum(c.n) FILTER (c.option <> t.value), 0)::BIGINT AS errors, coalesce(sum(c.n) FILTER (c.option = t.value), 0)::BIGINT AS matches
   FROM cs c JOIN t{i} t USING (part) {skip} GROUP BY c.source))"""


def sql(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = (f"WITH {ctes}\n{select}" if ctes else select).strip()


# --- reading and preparing ------------------------------------------------------------------

sql("scan_table", "", "SELECT * FROM customer")
sql("bind_observed", "", f"SELECT *, {ident('c_custkey')} AS row_id FROM customer")
sql("multi_dataset", "", f"""SELECT 'customer' AS dataset, {ident('c_custkey')} AS row_id, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', {ident('s_suppkey')}, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
sql("align_columns", PARTS, "SELECT row_id, NULL::VARCHAR AS name, p_name AS name_obs, p_type AS type FROM parts")
sql("ref_lookup", "", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
PATH = "customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
sql("ref_path", "", f"SELECT c_custkey, n_name, r_name FROM {PATH}")
sql("derived_column", "", f"SELECT c_custkey, r_name || '_' || c_mktsegment AS r_name_segment, round_even(c_acctbal, 0)::DOUBLE AS balance FROM {PATH}")
sql("blocking_key", PARTS, "SELECT row_id, substr(p_name, 1, 1) || right(split_part(p_name, ' ', 1), 1) AS key FROM parts")
sql("type_align", "", "SELECT c_custkey::VARCHAR AS c_custkey, c_nationkey::VARCHAR AS c_nationkey FROM customer")
sql("missing_policy", PARTS, """SELECT 'p_name' AS "column", count(p_name) AS n_observed, count(*) FILTER (p_name IS NULL) AS n_missing_as_observation, 0::BIGINT AS n_to_impute FROM parts
UNION ALL SELECT 'p_type', count(p_type), 0, count(*) FILTER (p_type IS NULL) FROM parts
UNION ALL SELECT 'p_brand', count(p_brand), 0, count(*) FILTER (p_brand IS NULL) FROM parts""")
sql("approx_equal", PRICES, """SELECT row_id, abs(noisy - shown) <= 1.5e-8 * greatest(abs(noisy), abs(shown)) AS same,
 abs(noisy - shown * 1000) <= 1.5e-8 * greatest(abs(noisy), abs(shown * 1000)) AS same_in_thousands FROM prices""")


def subsequence(short: str, long: str) -> str:
    return f"regexp_matches(lower({long}), array_to_string(list_transform(string_split(lower({short}), ''), lambda x: regexp_escape(x)), '.*'))"


sql("is_abbreviation", NAMES, f"SELECT row_id, {subsequence(chr(39).join(['replace(shown, ', '.', ', ', '', ')']), 'concat_ws(' + repr(' ') + ', first, middle, last)')} AS of_full, {subsequence('substr(middle, 1, 2)', 'last')} AS of_last FROM names")
sql("time_valid", TIMES, f"SELECT row_id, {TIME_OK % 'time_text'} AS valid FROM times")
sql("source_override", CLAIMS, f"SELECT row_id, CASE WHEN part % 100 = source THEN 1.0e-5 ELSE round({10 / 60!r}e0, 6) END AS error_rate FROM claims")

# --- domains ------------------------------------------------------------------------------------

sql("domain_global", PARTS, """SELECT DISTINCT 'p_name' AS "column", p_name AS option FROM parts WHERE p_name IS NOT NULL
UNION ALL SELECT DISTINCT 'p_type', p_type FROM parts WHERE p_type IS NOT NULL UNION ALL SELECT DISTINCT 'p_brand', p_brand FROM parts WHERE p_brand IS NOT NULL""")
GROUPED = CLAIMS + ", dg AS (SELECT DISTINCT part, claim AS option FROM claims WHERE claim IS NOT NULL), dm AS (SELECT part, option, -ln(count(*) OVER (PARTITION BY part)::DOUBLE) AS log_prior FROM dg)"
sql("domain_grouped", GROUPED, "SELECT part, option FROM dg")
sql("domain_lookup", GROUPED, f"SELECT row_id, claim AS option, {r('log_prior')} AS log_prior FROM claims JOIN dm ON dm.part = claims.part AND dm.option = claims.claim")
sql("domain_uniform", CLAIMS, f"SELECT option, {r('-ln(count(*) OVER ()::DOUBLE)')} AS log_prior FROM (SELECT DISTINCT claim AS option FROM claims)")
sql("domain_weighted", CLAIMS, f"SELECT claim AS option, {r('ln(count(*)::DOUBLE / sum(count(*)) OVER ())')} AS log_prior FROM claims GROUP BY claim")
sql("domain_time", TIMES + f", d AS (SELECT DISTINCT time_text AS option FROM times), s AS (SELECT option, CASE WHEN {TIME_OK % 'option'} THEN -ln(1440.0e0) ELSE {FLOOR} END AS log_prior FROM d), t AS (SELECT least(ln(sum(exp(log_prior))), -1.0e-12) AS t FROM s)",
    f"SELECT option, {r('log_prior')} AS log_prior, false AS is_placeholder FROM s UNION ALL SELECT '**:** p.m.', {r('ln(1.0e0 - exp(t))')}, true FROM t")
sql("domain_with_other", f"{PARTS},\n{TEXTS},\nwords AS (SELECT DISTINCT p_name AS word FROM parts WHERE p_name IS NOT NULL),\n{bigrams('bg', 'texts', 'text')},\n{text_prior('tp', 'words', 'bg')}, m AS (SELECT max(logp) AS m FROM tp), t AS (SELECT least(any_value(m) + ln(sum(exp(logp - m))), -1.0e-12) AS t FROM tp, m)",
    f"SELECT word AS option, {r('logp')} AS log_prior, false AS is_placeholder FROM tp UNION ALL SELECT repeat('*', 16), {r('ln(1.0e0 - exp(t))')}, true FROM t")
sql("enumerate_options", GROUPED, f"SELECT part, option, {r('log_prior')} AS log_prior FROM dm JOIN part ON p_partkey = dm.part")

# --- candidates -----------------------------------------------------------------------------------

BLOCK = f"{FLAT},\n{TUPLES}, ne AS (SELECT {ident('n_name', 'r_name')} AS entity_id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"
sql("candidates_blocked", BLOCK, "SELECT nation, tup.region, entity_id FROM tup JOIN ne ON ne.region IS NOT DISTINCT FROM tup.region")
sql("candidates_constrained", BLOCK, "SELECT nation, tup.region, entity_id FROM tup JOIN ne ON ne.region IS NOT DISTINCT FROM tup.region AND nation IS NOT DISTINCT FROM name")
PAIRS = PARTS + """, ob AS (SELECT DISTINCT p_name AS observed FROM parts), wo AS (SELECT DISTINCT p_name AS word FROM part),
pk AS (SELECT observed, word, damerau_levenshtein(observed, word)::INT AS k FROM ob, wo), pr AS (SELECT * FROM pk WHERE k <= 2)"""
sql("candidates_unblocked", PAIRS, "SELECT observed, word FROM pr")
sql("candidates_qgram", PAIRS, "SELECT observed, word FROM pr")
sql("edit_distance", PAIRS, "SELECT observed, word, k FROM pr")

# --- likelihoods -------------------------------------------------------------------------------------

sql("typo_loglik", PAIRS, f"SELECT observed, word, {r(typo_loglik('k', 'word'))} AS loglik FROM pr")
MISSING_CLAIMS = CLAIMS + f", mc AS (SELECT row_id, part, truth, CASE WHEN {u('missing.claim')} >= 0.1e0 THEN claim END AS claim FROM claims), md AS (SELECT DISTINCT part, claim AS option FROM mc WHERE claim IS NOT NULL), ms AS (SELECT part, count(*)::DOUBLE AS m FROM md GROUP BY part)"
sql("swap_loglik", MISSING_CLAIMS, f"""SELECT row_id, {r("CASE WHEN claim IS NULL THEN CASE WHEN md.option IS NOT NULL THEN 0.0e0 ELSE -1000.0e0 END WHEN claim = truth THEN ln(1.0e0 - 0.1e0) ELSE ln(0.1e0) - ln(coalesce(m, 1.0e0)) END")} AS loglik
FROM mc LEFT JOIN ms USING (part) LEFT JOIN md ON md.part = mc.part AND md.option = mc.truth""")
sql("uniform_loglik", GROUPED + ", gs AS (SELECT part, count(*)::DOUBLE AS m FROM dg GROUP BY part)", f"SELECT row_id, {r('-ln(m)')} AS loglik FROM claims JOIN gs USING (part)")
sql("proportional_loglik", CLAIMS + ", w AS (SELECT claim, ln(count(*)::DOUBLE / sum(count(*)) OVER ()) AS x FROM claims GROUP BY claim)", f"SELECT row_id, {r('x')} AS loglik FROM claims JOIN w USING (claim)")
sql("gaussian_loglik", PRICES, f"SELECT row_id, {r(norm('noisy', 'truth', '10.0e0'))} AS loglik FROM prices")
sql("unit_loglik", PRICES, f"""SELECT row_id, 'identity' AS unit, {r(norm('shown', 'truth', '150.0e0'))} AS loglik FROM prices
UNION ALL SELECT row_id, 'thousands', {r('(' + norm('(shown * 1000.0e0)', 'truth', '150.0e0') + ' - ln(abs(0.001e0)))')} FROM prices""")
sql("char_bigram", f"{TEXTS},\n{bigrams('bg', 'texts', 'text')}", f"SELECT prev, next, n, {r('p')} AS p FROM bg")
sql("string_prior", f"{TEXTS},\nwords AS (SELECT DISTINCT p_name AS word FROM part),\n{bigrams('bg', 'texts', 'text')},\n{text_prior('tp', 'words', 'bg')}", f"SELECT word, {r('logp')} AS logp FROM tp")
sql("time_prior", TIMES, f"SELECT row_id, CASE WHEN {TIME_OK % 'time_text'} THEN {r('-ln(1440.0e0)')} ELSE {FLOOR} END AS logp FROM times")
sql("number_prior", "", f"SELECT c_custkey, CASE WHEN c_custkey > 0 THEN {r('-ln(c_custkey::DOUBLE)')} ELSE {FLOOR} END AS logp FROM customer")
sql("name_loglik", NAMES_MISSING, f"""SELECT row_id, CASE WHEN shown IS NULL THEN 0.0e0 WHEN lower(shown) = lower(first || ' ' || middle || ' ' || last) THEN {r('3.0e0 * ln(0.9e0)')}
 WHEN lower(shown) = lower(first || ' ' || last) THEN {r('ln(0.1e0)')} ELSE -1000.0e0 END AS loglik FROM shown""")
sql("initial_loglik", NAMES_MISSING, f"""SELECT row_id, CASE WHEN shown IS NULL THEN CASE WHEN first IS NULL OR first = '' THEN 0.0e0 WHEN contains(first, '*') THEN -1000.0e0 ELSE -5.0e0 END
 WHEN first = '' THEN -1000.0e0 WHEN lower(split_part(shown, ' ', 1)) = lower(first) THEN {r('ln(0.9999e0)')}
 WHEN lower(split_part(shown, ' ', 1)) = lower(first[1] || '.') THEN {r('ln(0.0001e0)')} ELSE -1000.0e0 END AS loglik FROM shown""")
SHORTS = PARTS + """, sh AS (SELECT row_id, substr(clean_name, 1, 1) || substr(split_part(clean_name, ' ', 2), 1, 2) AS short, clean_name, p_name FROM parts),
so AS (SELECT DISTINCT clean_name AS option FROM sh)"""
sql("abbrev_loglik", SHORTS + f", sp AS (SELECT DISTINCT short, p_name AS observed FROM sh), sm AS (SELECT short, count(*)::DOUBLE AS m FROM (SELECT DISTINCT short FROM sh), so WHERE {subsequence('short', 'option')} GROUP BY short)",
    f"SELECT short, observed, CASE WHEN {subsequence('short', 'observed')} THEN {r('-ln(m)')} ELSE -1000.0e0 END AS loglik FROM sp JOIN sm USING (short)")

# --- sums, posteriors --------------------------------------------------------------------------------------

sql("logsumexp", TOTALS, f"SELECT part, {r('lse')} AS lse FROM lse")
sql("normalize_weights", CLAIMS, f"SELECT claim AS option, {r('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS weight, {r('ln(count(*)::DOUBLE / sum(count(*)) OVER ())')} AS log_weight FROM claims GROUP BY claim")
sql("candidate_posterior", TOTALS, f"SELECT part, option, {r('exp(score - lse)')} AS p FROM scores JOIN lse USING (part)")
sql("link_ambiguity", TOTALS, f"SELECT part, {r('1.0e0 / sum(exp(score - lse) * exp(score - lse))')} AS ess FROM scores JOIN lse USING (part) GROUP BY part")
sql("log_marginal", TOTALS, "SELECT round(sum(lse), 4) AS total FROM lse")

# --- counts, parameters ---------------------------------------------------------------------------------------

REFS = CLAIMS + ", refs AS (SELECT part, count(*) AS n FROM claims GROUP BY part)"
sql("ref_counts", REFS, "SELECT part, n, (sum(n) OVER ())::BIGINT AS total FROM refs")
sql("py_prior", REFS, f"""SELECT part::VARCHAR AS entity, {r(f'ln(n - {D}) - ln((SELECT sum(n) FROM refs)::DOUBLE + {S})')} AS logp FROM refs
UNION ALL SELECT 'new', {r(f'ln(count(*) * {D} + {S}) - ln(sum(n)::DOUBLE + {S})')} FROM refs""")
# Sums over every member of every cluster, in any order.
PY = REFS + """, grid AS (SELECT s, d FROM (SELECT unnest([0.5e0, 1.0e0, 2.0e0, 4.0e0, 8.0e0]) AS s), (SELECT unnest([0.0e0, 0.25e0, 0.5e0]) AS d)),
joins AS (SELECT unnest(range(1, n)) AS i FROM refs), ji AS (SELECT i, count(*) AS m FROM joins GROUP BY i),
py AS (SELECT s AS strength, d AS discount,
  (SELECT sum(ln(k * d + s)) FROM range((SELECT count(*) FROM refs)) t(k))
  + (SELECT sum(m * ln(i - d)) FROM ji)
  - (SELECT sum(ln(j + s)) FROM range((SELECT sum(n)::BIGINT FROM refs)) t(j)) AS score FROM grid)"""
sql("py_score", PY, "SELECT strength, discount, round(score, 3) AS score FROM py")
sql("learn_py_params", PY, "SELECT strength, discount, round(score, 3) AS score FROM py ORDER BY py.score DESC, strength, discount LIMIT 1")
sql("observation_counts", FLAT, """SELECT true_nation AS entity, 'segment' AS "column", count(segment) AS n_observed, min(segment) AS value FROM flat GROUP BY true_nation
UNION ALL SELECT true_nation, 'region', count(region), min(region) FROM flat GROUP BY true_nation""")
sql("counts_categorical", CLAIMS, "SELECT claim AS option, count(*) AS n FROM claims GROUP BY claim")
sql("learn_proportions", CLAIMS, f"SELECT option, {r('(1.0e0 + n) / sum(1.0e0 + n) OVER ()')} AS p FROM (SELECT o.option, count(c.row_id) AS n FROM opts o LEFT JOIN claims c ON c.claim = o.option GROUP BY o.option)")
ERR = "count(*) FILTER (claim <> truth) AS errors, count(*) FILTER (claim = truth) AS matches"
sql("counts_error", CLAIMS, f"SELECT {ERR} FROM claims")
sql("learn_error_rate", CLAIMS, f"SELECT {r('(1.0e0 + errors) / (4.0e0 + errors + matches)')} AS rate FROM (SELECT {ERR} FROM claims)")
BYSRC = CLAIMS + f", bs AS (SELECT source, {ERR} FROM claims GROUP BY source), br AS (SELECT source, (10.0e0 + errors) / (60.0e0 + errors + matches) AS rate FROM bs)"
sql("counts_error_grouped", BYSRC, "SELECT * FROM bs")
sql("stream_error_rate", BYSRC, "SELECT * FROM bs")
sql("learn_error_rate_by_source", BYSRC, f"SELECT source, {r('rate')} AS rate FROM br")
sql("param_lookup", BYSRC, f"SELECT c_custkey AS source, {r(f'coalesce(rate, {10 / 60!r}e0)')} AS rate FROM customer LEFT JOIN br ON source = c_custkey")
sql("stats_gaussian", PRICES, "SELECT part, 10.0e0 AS std, count(*) AS n, round(sum(noisy), 4) AS sum FROM prices GROUP BY part")
UNIT = f"CASE WHEN round({norm('(shown * 1000.0e0)', '%s', '150.0e0')} - ln(0.001e0), 6) > round({norm('shown', '%s', '150.0e0')}, 6) THEN 'thousands' ELSE 'identity' END"


def unit_of(mean: str) -> str:
    return UNIT.replace("%s", mean)


def base_of(mean: str) -> str:
    return f"CASE WHEN {unit_of(mean)} = 'thousands' THEN shown * 1000.0e0 ELSE shown END"


sql("stats_gaussian_units", PRICES, f"SELECT part, 150.0e0 AS std, count(*) AS n, round(sum({base_of('truth')}), 4) AS sum FROM prices GROUP BY part")
sql("learn_mean", PRICES, f"SELECT part, {r('(1500.0e0 / 1.0e6 + sum(noisy) / 100.0e0) / (1.0e0 / 1.0e6 + count(*) / 100.0e0)')} AS mean FROM prices GROUP BY part")

def normal_draw(tag: str, key: str) -> str:
    return f"(sqrt(-2.0e0 * ln({u(tag + '.r', key)})) * cos(2.0e0 * pi() * {u(tag + '.a', key)}))"


def gamma_draw(shape: str, tag: str, key: str) -> str:
    """The first good one of 16 tries."""
    own = f"(i::VARCHAR || '|' || {key})"
    d = f"(CASE WHEN {shape} < 1.0e0 THEN {shape} + 1.0e0 ELSE {shape} END - 1.0e0 / 3.0e0)"
    tries = f"list_transform(range(16), lambda i: {{'x': {normal_draw(tag, own)}, 'u': {u(tag + '.u', own)}}})"
    cubed = f"list_transform({tries}, lambda t: {{'x': t.x, 'u': t.u, 'v': pow(1.0e0 + t.x / sqrt(9.0e0 * {d}), 3.0e0)}})"
    good = f"list_filter({cubed}, lambda t: CASE WHEN t.v > 0 THEN ln(t.u) < 0.5e0 * t.x * t.x + {d} - {d} * t.v + {d} * ln(t.v) ELSE false END)"
    return f"(({d} * {good}[1].v) * CASE WHEN {shape} < 1.0e0 THEN pow({u(tag + '.s', key)}, 1.0e0 / {shape}) ELSE 1.0e0 END)"


sql("learn_sampled", BYSRC + f", dr AS (SELECT source, {gamma_draw('(10.0e0 + errors)', 'rate.x', 'source::VARCHAR')} AS x, {gamma_draw('(50.0e0 + matches)', 'rate.y', 'source::VARCHAR')} AS y FROM bs)",
    f"SELECT source, {r('(x / (x + y))')} AS rate FROM dr")
sql("learn_sampled_proportions", FLAT + f""", nn AS (SELECT true_region, true_segment, count(*) AS n FROM flat GROUP BY ALL),
sh AS (SELECT true_region, true_segment, (n + length(true_segment) / 10.0e0)::DOUBLE AS a, {ident('true_region', 'true_segment')} AS k FROM nn),
dr AS (SELECT true_region, true_segment, {gamma_draw('a', 'share', 'k')} AS g FROM sh)""",
    f"SELECT true_region, true_segment, {r('(g / sum(g) OVER (PARTITION BY true_region))')} AS p FROM dr")
sql("learn_sampled_means", PRICES + f""", ms AS (SELECT part, count(*) AS n, (1500.0e0 / 1.0e6 + sum(noisy) / 100.0e0) / (1.0e0 / 1.0e6 + count(*) / 100.0e0) AS mean,
   1.0e0 / 1.0e6 + count(*) / 100.0e0 AS precision, {ident('part')} AS k FROM prices GROUP BY part)""",
    f"SELECT part, n, {r('(mean + sqrt(1.0e0 / precision) * ' + normal_draw('mean', 'k') + ')')} AS mean FROM ms")

# --- truth discovery -----------------------------------------------------------------------------------------------

FLAGS = """cnt AS (SELECT l_partkey, l_returnflag AS option, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ALL),
siz AS (SELECT l_partkey, count(*)::DOUBLE AS m FROM cnt GROUP BY l_partkey),
ev AS (SELECT o.l_partkey, o.option, any_value(m) AS m, sum(c.n * CASE WHEN c.option = o.option THEN ln(1.0e0 - 0.1e0) ELSE ln(0.1e0) - ln(m) END) AS loglik
   FROM cnt o JOIN cnt c USING (l_partkey) JOIN siz USING (l_partkey) GROUP BY o.l_partkey, o.option)"""
sql("entity_evidence", FLAGS, f"SELECT l_partkey, option, {r('loglik')} AS loglik FROM ev")
sql("truth_discovery", FLAGS + f", sc AS (SELECT *, loglik - ln(m) AS score FROM ev), {best('b', 'sc', 'l_partkey', 'score', 'option')}, mx AS (SELECT l_partkey, max(score) AS mx FROM sc GROUP BY l_partkey), z AS (SELECT l_partkey, sum(exp(score - mx)) AS z, any_value(mx) AS mx FROM sc JOIN mx USING (l_partkey) GROUP BY l_partkey)",
    f"SELECT l_partkey, option AS value, {r('exp(score - mx) / z')} AS posterior FROM b JOIN z USING (l_partkey)")
sql("truth_discovery_em", f"{EM_COUNTS},\n{em_round(0, False)},\n{em_round(1, False)}", f"SELECT part, value, {r('posterior')} AS posterior FROM t1")
sql("source_rates_em", f"{EM_COUNTS},\n{em_round(0, True)},\n{em_round(1, True)}", f"SELECT source, errors, matches, {r('rate')} AS rate FROM r1")

# --- linking -----------------------------------------------------------------------------------------------------------

sql("link_map", f"{CAND},\n{best('b', 'cand', 'nation, region')}", f"SELECT f.row_id, b.entity_id, {r('b.score')} AS score FROM flat f LEFT JOIN b ON {SAME.format('f', 'b')}")
sql("link_topk", f"{CAND}, rk AS (SELECT *, row_number() OVER (PARTITION BY nation, region ORDER BY round(score, 6) DESC, entity_id)::INT AS rank FROM cand)",
    f"SELECT f.row_id, rk.rank, rk.entity_id, {r('rk.score')} AS score FROM flat f LEFT JOIN rk ON {SAME.format('f', 'rk')} AND rk.rank <= 3")
CDF = f"""{CAND}, zz AS (SELECT nation, region, max(score) AS mx FROM cand GROUP BY ALL),
zs AS (SELECT c.nation, c.region, any_value(mx) + ln(sum(exp(score - mx))) AS lse FROM cand c JOIN zz ON {SAME.format('c', 'zz')} GROUP BY ALL),
cd AS (SELECT c.nation, c.region, entity_id, score, round(sum(exp(score - lse)) OVER (PARTITION BY c.nation, c.region ORDER BY entity_id ROWS UNBOUNDED PRECEDING), 9) AS hi FROM cand c JOIN zs ON {SAME.format('c', 'zs')}),
cl AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY nation, region ORDER BY entity_id), 0.0e0) AS lo FROM cd)"""


def drawn(tag: str) -> str:
    return f"SELECT f.row_id, cl.entity_id, cl.score FROM flat f LEFT JOIN cl ON {SAME.format('f', 'cl')} AND {u(tag, 'f.row_id')} * 0.999999998e0 >= lo AND {u(tag, 'f.row_id')} * 0.999999998e0 < hi"


sql("link_sampled", f"{CDF}, dr AS ({drawn('link')})", "SELECT row_id, entity_id FROM dr")
sql("accept_or_keep", f"{CDF}, dr AS ({drawn('propose')}), {best('b', 'cand', 'nation, region')}, ol AS (SELECT f.row_id, b.entity_id, b.score FROM flat f LEFT JOIN b ON {SAME.format('f', 'b')}), ac AS (SELECT ol.row_id, ol.entity_id AS old_id, dr.entity_id AS new_id, coalesce({u('accept', 'ol.row_id')} < exp(least(dr.score - ol.score, 0.0e0)), false) AS accepted FROM ol JOIN dr USING (row_id))",
    "SELECT row_id, CASE WHEN accepted THEN new_id ELSE old_id END AS entity_id, accepted FROM ac")
sql("link_staged", f"""{CAND}, rg AS (SELECT region, sum(n) AS n FROM ents GROUP BY region), rp AS (SELECT region, ln(n - {D}) - ln((SELECT sum(n) FROM rg)::DOUBLE + {S}) AS stage1 FROM rg),
top2 AS (SELECT region FROM rp ORDER BY round(stage1, 6) DESC, region LIMIT 2),
st AS (SELECT c.nation, c.region, e_nation, e_region, score + stage1 AS score, c.region IS NULL AND c.e_region NOT IN (SELECT region FROM top2) AS outside FROM cand c JOIN rp ON c.e_region = rp.region),
ins AS (SELECT nation, region, min(outside) AS none FROM st GROUP BY ALL),
st2 AS (SELECT st.* FROM st JOIN ins ON {SAME.format('st', 'ins')} WHERE st.outside = ins.none),
{best('b', 'st2', 'nation, region', 'score', 'e_nation')}""", f"SELECT f.row_id, b.e_region AS region, b.e_nation AS nation, {r('b.score')} AS score FROM flat f LEFT JOIN b ON {SAME.format('f', 'b')}")
sql("initial_link", INITIAL, f"SELECT f.row_id, l.entity_id, l.is_new FROM flat f JOIN l0 l ON {SAME.format('f', 'l')}")
sql("new_entities", f"{FLAT},\n{TUPLES},\n{NATIONS},\n{linked('ln', 'tup', 'ents', 1)}", "SELECT entity_id, nation, region, c AS n FROM ln WHERE is_new")
sql("relink", f"""{CAND}, nw AS (SELECT nation AS word, sum(c)::BIGINT AS c FROM tup GROUP BY nation),
{bigrams('bg', 'nw', 'word', 'c')},
{text_prior('tp', 'nw', 'bg', tails=True)},
op0 AS (SELECT o.word AS observed, w.word, w.logp, damerau_levenshtein(o.word, w.word) AS k FROM nw o, tp w),
op AS (SELECT observed, logp + {typo_loglik('k', 'word')} AS x FROM op0 WHERE k <= 2),
om AS (SELECT observed, max(x) AS mx FROM op GROUP BY observed), os AS (SELECT observed, any_value(mx) + ln(sum(exp(x - mx))) AS lse FROM op JOIN om USING (observed) GROUP BY observed),
both_ AS (SELECT nation, region, entity_id, score, false AS is_new FROM cand
  UNION ALL SELECT nation, region, {OWN_ID.format('')}, ln((SELECT count(*) FROM ents) * {D} + {S}) - ln((SELECT sum(n) FROM ents)::DOUBLE + {S}) + lse
     - CASE WHEN region IS NULL THEN 0.0e0 ELSE ln((SELECT count(DISTINCT region) FROM tup)::DOUBLE) END, true FROM tup JOIN os ON observed = nation),
{best('b', 'both_', 'nation, region', 'score', 'is_new, entity_id')}""", f"SELECT f.row_id, b.entity_id, b.is_new FROM flat f JOIN b ON {SAME.format('f', 'b')}")

sql("merge_new_entities", f"""{FLAT},
{TUPLES},
{NATIONS},
enh AS (SELECT * FROM ents WHERE nation IN (SELECT n_name FROM nation WHERE n_nationkey < 12)),
{linked('m0', 'tup', 'enh')},
nu AS (SELECT nation, region, c FROM m0 WHERE is_new),
{seeds('ms', 'nu')},
{linked('m1', 'nu', 'ms')}""", f"SELECT f.row_id, coalesce(b.entity_id, a.entity_id) AS entity_id, a.is_new FROM flat f JOIN m0 a ON {SAME.format('f', 'a')} LEFT JOIN m1 b ON {SAME.format('f', 'b')}")


def swept_learned(i: int) -> str:
    """CTEs of full sweep ``i``: entities e{i}, prior py{i}, weights w{i} and links l{i} from links l{i-1}."""
    n, s, d = f"x{i}", f"(SELECT strength FROM py{i})", f"(SELECT discount FROM py{i})"
    found = swept(i)
    entities = found[: found.index(f"l{i}_c_k AS")].rstrip().rstrip(",")
    scored = candidates(f"{n}_ca", "tup", f"{n}_e")
    scored = scored.replace(f"ln(n - {D})", f"ln(n - {d})").replace(f"::DOUBLE + {S})", f"::DOUBLE + {s})")
    return f"""{entities},
{n}_g AS (SELECT s, d FROM (SELECT unnest([0.5e0, 1.0e0, 2.0e0, 4.0e0, 8.0e0]) AS s), (SELECT unnest([0.0e0, 0.25e0, 0.5e0]) AS d)),
{n}_py AS (SELECT s AS strength, d AS discount, (SELECT sum(ln(k * d + s)) FROM range((SELECT count(*) FROM {n}_e)) t(k))
   + (SELECT sum(lgamma(n - d) - lgamma(1.0e0 - d)) FROM {n}_e) - (lgamma((SELECT sum(n) FROM {n}_e) + s) - lgamma(s)) AS score FROM {n}_g),
py{i} AS (SELECT * FROM {n}_py ORDER BY round(score, 6) DESC, strength, discount LIMIT 1),
{n}_o AS (SELECT DISTINCT region FROM tup WHERE region IS NOT NULL),
w{i} AS (SELECT region, (1.0e0 + coalesce(n, 0)) / sum(1.0e0 + coalesce(n, 0)) OVER () AS p FROM {n}_o LEFT JOIN (SELECT region, sum(n) AS n FROM {n}_e WHERE region IS NOT NULL GROUP BY region) USING (region)),
{scored},
{n}_both AS (SELECT nation, region, c, entity_id, score, false AS is_new FROM {n}_ca
  UNION ALL SELECT t.nation, t.region, t.c, {OWN_ID.format('t.')}, ln((SELECT count(*) FROM {n}_e) * {d} + {s}) - ln((SELECT sum(n) FROM {n}_e)::DOUBLE + {s}) + lse
     + CASE WHEN t.region IS NULL THEN 0.0e0 ELSE ln(w.p) END, true FROM tup t JOIN os ON observed = t.nation LEFT JOIN w{i} w ON w.region = t.region),
{best(f'l{i}', n + '_both', 'nation, region', 'score', 'is_new, entity_id')},
e{i} AS (SELECT * FROM {n}_e WHERE entity_id IN (SELECT entity_id FROM l{i}))"""


FULL_SWEEPS = f"""{INITIAL},
nw AS (SELECT nation AS word, sum(c)::BIGINT AS c FROM tup GROUP BY nation),
{bigrams('bg', 'nw', 'word', 'c')},
{text_prior('tp', 'nw', 'bg', tails=True)},
op AS (SELECT o.word AS observed, w.logp + {typo_loglik('damerau_levenshtein(o.word, w.word)', 'w.word')} AS x FROM nw o JOIN tp w ON damerau_levenshtein(o.word, w.word) <= 2),
os AS (SELECT observed, any_value(mx) + ln(sum(exp(x - mx))) AS lse FROM op JOIN (SELECT observed, max(x) AS mx FROM op GROUP BY observed) USING (observed) GROUP BY observed),
{swept_learned(1)},
{swept_learned(2)}"""
sql("sweep_learned", FULL_SWEEPS, f"""SELECT f.row_id, coalesce(e.nation, f.nation) AS nation, coalesce(e.region, f.region) AS region, l.entity_id, l.is_new, {r('l.score')} AS score
 FROM flat f JOIN l2 l ON {SAME.format('f', 'l')} LEFT JOIN e2 e USING (entity_id)""")
sql("sweep_progress", FULL_SWEEPS, " UNION ALL ".join(
    f"SELECT {i} AS sweep, strength, discount, (SELECT count(*) FROM l{i}) AS tuples, (SELECT sum(c)::BIGINT FROM l{i}) AS records, (SELECT coalesce(sum(c) FILTER (is_new), 0)::BIGINT FROM l{i}) AS opened,"
    f" (SELECT round(sum(score * c), 3) FROM l{i}) AS score FROM py{i}" for i in (1, 2)))

# --- entity tables ---------------------------------------------------------------------------------------------------------

sql("referring_rows", "", """SELECT 'customer.nation' AS path, c_nationkey::VARCHAR AS entity, count(*) AS n FROM customer GROUP BY ALL
UNION ALL SELECT 'supplier.nation', s_nationkey::VARCHAR, count(*) FROM supplier GROUP BY ALL UNION ALL SELECT 'nation.region', n_regionkey::VARCHAR, count(*) FROM nation GROUP BY ALL""")
sql("referring_along", "", """SELECT 'customer' AS path, o_custkey::VARCHAR AS entity, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'customer.nation', c_nationkey::VARCHAR, count(*) FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL
UNION ALL SELECT 'customer.nation.region', n_regionkey::VARCHAR, count(*) FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
sql("prune_orphans", "", "SELECT c_custkey AS entity_id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
sql("prune_cascade", "c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)), g AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))",
    "SELECT 'customer' AS class, c_custkey::VARCHAR AS entity FROM c UNION ALL SELECT 'nation', n_nationkey::VARCHAR FROM n UNION ALL SELECT 'region', r_regionkey::VARCHAR FROM g")
sql("sweep_once", SWEEP1, "SELECT row_id, nation, region FROM fixed1")
sql("sweep_twice", SWEEP2, "SELECT row_id, nation, region FROM fixed2")
sql("normalize_tables", SWEEP1, f"""SELECT 'nation' AS class, entity_id, 'nation' AS attribute, nation AS value FROM e1 UNION ALL SELECT 'nation', entity_id, 'region_id', {ident('region')} FROM e1
UNION ALL SELECT DISTINCT 'region', {ident('region')}, 'region', region FROM e1 WHERE region IS NOT NULL""")
sql("inferred_entities", SWEEP1, f"SELECT entity_id, nation, {ident('region')} AS region_id, n FROM e1")
sql("reconstruct_flat", f"{SWEEP1},\n{column_repair('seg', 'flat', 'segment')}", "SELECT f.row_id, f.c_name, s.repaired AS segment, x.nation, x.region FROM flat f JOIN fixed1 x USING (row_id) JOIN seg s USING (row_id)")
sql("repair_log", SWEEP1, """SELECT f.row_id, 'nation' AS "column", f.nation AS old, x.nation AS new FROM flat f JOIN fixed1 x USING (row_id) WHERE f.nation IS DISTINCT FROM x.nation
UNION ALL SELECT f.row_id, 'region', f.region, x.region FROM flat f JOIN fixed1 x USING (row_id) WHERE f.region IS DISTINCT FROM x.region""")
sql("entity_log", SWEEP1, """SELECT 'nation' AS class, entity_id, 'deleted' AS change FROM (SELECT entity_id FROM sd EXCEPT SELECT entity_id FROM e1)
UNION ALL SELECT 'nation', entity_id, 'new' FROM (SELECT entity_id FROM e1 EXCEPT SELECT entity_id FROM sd)""")
sql("export_json", SWEEP1, "SELECT entity_id, CASE WHEN region IS NULL THEN to_json({'nation': nation}) ELSE to_json({'nation': nation, 'region': region}) END::VARCHAR AS json FROM e1")

# --- repairs -------------------------------------------------------------------------------------------------------------------

sql("impute", f"{PARTS},\n{IMPUTE}", "SELECT row_id, p_type, was_missing FROM imputed")
MARKETS = f"""
mk0 AS (SELECT {ident('c_custkey')} AS row_id, c_mktsegment AS true_segment, n_name AS true_nation, r_name AS true_region
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
{typo_steps('mk0', 'true_segment', 'typed_segment', 'mk1')},
{typo_steps('mk1', 'true_nation', 'typed_nation', 'mk2')},
{typo_steps('mk2', 'true_region', 'typed_region', 'mk3')},
mk AS (SELECT row_id, true_segment, true_nation, true_region, {', '.join(f"CASE WHEN {u('missing.typed_' + c)} >= 0.1e0 THEN typed_{c} END AS {c}" for c in ('segment', 'nation', 'region'))} FROM mk3),
up0 AS (SELECT segment, nation, region, count(*) AS c FROM mk GROUP BY ALL)"""


def nested_level(i: int, column: str, ref: str, below: list[str]) -> str:
    """CTEs of one class: its seeds sd{i}, tuples with its id up{i}, and of every sub-tuple each entity's fit fit{i} and the
    best entity of all, existing or new, top{i}."""
    keys = f"{column}, {ref}" if ref else column
    own_id = ident(f"coalesce(t.{column}, '')", *([f"coalesce(t.{ref}, '')"] if ref else []))
    new_id = ident(f"coalesce(s.{column}, '')", *([f"d.{ref}"] if ref else []))
    same_ref = f"AND (t.{ref} IS NULL OR t.{ref} = e.{ref})" if ref else ""
    on = " AND ".join(f"b.{k} IS NOT DISTINCT FROM t.{k}" for k in keys.split(", "))
    cells = ", ".join([column, *below])
    total, many = f"(SELECT sum(n) FROM sd{i})::DOUBLE", f"(SELECT count(*) FROM sd{i})"
    lower = f"JOIN fit{i - 1} d ON {' AND '.join(f'd.{b} IS NOT DISTINCT FROM s.{b}' for b in below)} AND d.id = e.{ref}" if ref else ""
    best_below = f"JOIN top{i - 1} d ON {' AND '.join(f'd.{b} IS NOT DISTINCT FROM s.{b}' for b in below)}" if ref else ""
    others = [f"{b}_id" for b in below]
    old_ids = "".join(f", d.{o}" for o in others)
    return f"""t{i} AS (SELECT {keys}, sum(c)::BIGINT AS c FROM up{i - 1} GROUP BY ALL),
{seeds(f'sd{i}', f't{i}', column, ref)},
ca{i} AS (SELECT t.*, e.entity_id, ln(e.n - {D}) - ln({total} + {S}) + {typo_loglik(f'damerau_levenshtein(t.{column}, e.{column})', f'e.{column}')} AS score
   FROM t{i} t JOIN sd{i} e ON damerau_levenshtein(t.{column}, e.{column}) <= 2 {same_ref}),
{best(f'cb{i}', f'ca{i}', keys)},
up{i} AS (SELECT t.*, CASE WHEN t.{column} IS NOT NULL THEN coalesce(b.entity_id, {own_id}) END AS {column}_id FROM up{i - 1} t LEFT JOIN cb{i} b ON {on}),
s{i} AS (SELECT DISTINCT {cells} FROM up0),
fit{i} AS (SELECT {', '.join('s.' + c for c in cells.split(', '))}, e.entity_id AS id, e.n{old_ids},
   CASE WHEN s.{column} IS NULL THEN 0.0e0 WHEN damerau_levenshtein(s.{column}, e.{column}) <= 2
     THEN {typo_loglik(f'damerau_levenshtein(s.{column}, e.{column})', f'e.{column}')} ELSE -1.0e5 END {'+ d.fit' if ref else ''} AS fit, e.entity_id AS {column}_id
   FROM s{i} s CROSS JOIN sd{i} e {lower}),
all{i} AS (SELECT {cells}, {', '.join([f'{column}_id', *others])}, false AS is_new, ln(n - {D}) - ln({total} + {S}) + fit AS score FROM fit{i}
   UNION ALL SELECT {', '.join('s.' + c for c in cells.split(', '))}, {new_id}{old_ids}, true, ln({many} * {D} + {S}) - ln({total} + {S})
     + CASE WHEN s.{column} IS NULL THEN 0.0e0 ELSE p.logp + {typo_loglik('0', f's.{column}')} END {'+ d.score' if ref else ''}
   FROM s{i} s LEFT JOIN sd{i}_tp p ON p.word = s.{column} {best_below}),
{best(f'top{i}', f'all{i}', cells, 'score', f'is_new, {column}_id')}"""


NESTED = f"""{MARKETS},
{nested_level(1, 'region', '', [])},
{nested_level(2, 'nation', 'region_id', ['region'])},
{nested_level(3, 'segment', 'nation_id', ['nation', 'region'])},
done AS (SELECT u.c, t.* FROM up0 u JOIN top3 t ON {' AND '.join(f'u.{c} IS NOT DISTINCT FROM t.{c}' for c in ('segment', 'nation', 'region'))})"""
sql("clean_nested", NESTED, f"""SELECT f.row_id, coalesce(m.segment, f.segment) AS segment, coalesce(n.nation, f.nation) AS nation, coalesce(r.region, f.region) AS region,
 t.segment_id AS "Market_id", t.nation_id AS "Nation_id", t.region_id AS "Region_id", t.is_new, {r('t.score')} AS score
 FROM mk f JOIN top3 t ON {' AND '.join(f'f.{c} IS NOT DISTINCT FROM t.{c}' for c in ('segment', 'nation', 'region'))}
 LEFT JOIN sd3 m ON m.entity_id = t.segment_id LEFT JOIN sd2 n ON n.entity_id = t.nation_id LEFT JOIN sd1 r ON r.entity_id = t.region_id""")
sql("nested_tables", NESTED, " UNION ALL ".join(
    f"SELECT '{name}' AS class, d.{c}_id AS entity_id, coalesce(any_value(e.{c}), min(d.{c})) AS value, {f'coalesce(any_value(e.{ref}), min(d.{ref}))' if ref else 'NULL::VARCHAR'} AS refers_to, sum(d.c)::BIGINT AS n"
    f" FROM done d LEFT JOIN sd{i} e ON e.entity_id = d.{c}_id GROUP BY d.{c}_id"
    for i, name, c, ref in ((3, "Market", "segment", "nation_id"), (2, "Nation", "nation", "region_id"), (1, "Region", "region", ""))))
sql("clean_two_tables", f"""{FLAT},
su0 AS (SELECT {ident('s_suppkey')} AS row_id, n_name AS true_nation FROM supplier JOIN nation ON s_nationkey = n_nationkey),
{typo_steps('su0', 'true_nation', 'nation', 'su')},
bo AS (SELECT 'customer' AS dataset, row_id, nation, region FROM flat UNION ALL SELECT 'supplier', row_id, nation, NULL FROM su),
up0 AS (SELECT nation, region, count(*) AS c FROM bo GROUP BY ALL),
{nested_level(1, 'region', '', [])},
{nested_level(2, 'nation', 'region_id', ['region'])}""", """SELECT f.dataset, f.row_id, coalesce(n.nation, f.nation) AS nation, CASE WHEN f.dataset = 'customer' THEN coalesce(r.region, f.region) END AS region,
 t.nation_id AS "Nation_id", t.region_id AS "Region_id" FROM bo f JOIN top2 t ON f.nation IS NOT DISTINCT FROM t.nation AND f.region IS NOT DISTINCT FROM t.region
 LEFT JOIN sd2 n ON n.entity_id = t.nation_id LEFT JOIN sd1 r ON r.entity_id = t.region_id""")


def swapped(src: str, column: str, source_column: str, name: str) -> str:
    """CTE: ``src`` with ``column``, which shows true_{column} or another value of the domain at its source's rate."""
    true = f"true_{column}"
    return f"""{name}_o AS (SELECT option, row_number() OVER (ORDER BY md5(option), option) AS idx, count(*) OVER () AS n_options
   FROM (SELECT DISTINCT {source_column} AS option FROM part WHERE {source_column} IS NOT NULL)),
{name} AS (SELECT b.*, CASE WHEN {u('swap.' + true)} < 0.05e0 + 0.4e0 * {u('rate', 'source')} THEN option ELSE {true} END AS {column}
   FROM {src} b JOIN {name}_o ON idx = floor({u('pick.' + true)} * (SELECT max(n_options) FROM {name}_o)) + 1)"""


# Both fields of a part are entities of their own: twice its number, and one more.
FIELDS = f"""fl0 AS (SELECT {LINE_ID} AS row_id, l_partkey AS part, l_suppkey AS source, p_type AS true_kind, p_brand AS true_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
{swapped('fl0', 'kind', 'p_type', 'fl1')},
{swapped('fl1', 'brand', 'p_brand', 'fl')},
cs AS (SELECT part, source, option, count(*) AS n FROM (SELECT part * 2 AS part, source, kind AS option FROM fl UNION ALL SELECT part * 2 + 1, source, brand FROM fl)
   WHERE option IS NOT NULL GROUP BY ALL),
""" + ",\n".join(em_round(i, True).replace("c.part % 100", "(c.part // 2) % 100") for i in range(5))
sql("clean_flights_like", FIELDS, """SELECT f.row_id, f.part, f.source, coalesce(a.value, f.kind) AS kind, coalesce(b.value, f.brand) AS brand
 FROM fl f LEFT JOIN t4 a ON a.part = f.part * 2 LEFT JOIN t4 b ON b.part = f.part * 2 + 1""")
sql("learned_rates", FIELDS, f"SELECT source, errors, matches, {r('rate')} AS rate FROM r4 WHERE errors + matches > 0")


def usual(name: str, src: str, column: str, by: Sequence[str]) -> str:
    """CTE: ``src`` with the gaps of ``column`` filled from their group, or else from the whole column."""
    keys = ", ".join(by)
    return f"""{name}_s AS (SELECT {keys}, {column} AS option, count(*) AS n FROM {src} WHERE {column} IS NOT NULL GROUP BY ALL),
{name}_o AS (SELECT option FROM (SELECT option, sum(n) AS n FROM {name}_s GROUP BY option) ORDER BY n DESC, option LIMIT 1),
{name}_l AS (SELECT {keys}, option AS _local FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, option) AS _rn FROM {name}_s) WHERE _rn = 1),
{name} AS (SELECT s.* REPLACE (coalesce(s.{column}, l._local, (SELECT option FROM {name}_o)) AS {column}) FROM {src} s
   LEFT JOIN {name}_l l ON {' AND '.join(f'l.{k} IS NOT DISTINCT FROM s.{k}' for k in by)})"""


def listed_base(mean: str) -> str:
    return base_of(mean).replace("shown", "amount")


LISTINGS = f"""ls0 AS (SELECT {LINE_ID} AS row_id, p_brand AS key, p_name AS true_place, p_type AS true_area, p_size::VARCHAR AS true_kind, p_retailprice AS true_amount
   FROM lineitem JOIN part ON p_partkey = l_partkey),
{typo_steps('ls0', 'true_place', 'place', 'ls1')},
ls AS (SELECT *, CASE WHEN {u('missing.true_area')} >= 0.15e0 THEN true_area END AS area, CASE WHEN {u('missing.true_kind')} >= 0.1e0 THEN true_kind END AS kind,
   CASE WHEN {u('unit.true_amount')} < 0.2e0 THEN round(true_amount * 0.001e0, 5) ELSE true_amount END AS amount FROM ls1),
lt AS (SELECT place, key, count(*) AS c FROM ls GROUP BY ALL),
{seeds('lsd', 'lt', 'place', 'key')},
lc AS (SELECT t.place, t.key, e.entity_id, e.place AS word, ln(e.n - {D}) - ln((SELECT sum(n) FROM lsd)::DOUBLE + {S}) + {typo_loglik('damerau_levenshtein(t.place, e.place)', 'e.place')} AS score
   FROM lt t JOIN lsd e ON (t.key IS NULL OR t.key = e.key) AND damerau_levenshtein(t.place, e.place) <= 2),
{best('lb', 'lc', 'place, key')},
l1 AS (SELECT s.row_id, s.key, coalesce(b.word, s.place) AS place, s.area, s.kind, s.amount FROM ls s LEFT JOIN lb b ON b.place = s.place AND b.key IS NOT DISTINCT FROM s.key),
{usual('l2', 'l1', 'area', ['key', 'place'])},
{usual('l3', 'l2', 'kind', ['key', 'place'])},
lu AS (SELECT area, key, kind, (1500.0e0 / 1.0e6 + sum({listed_base('1500.0e0')}) / 22500.0e0) / (1.0e0 / 1.0e6 + count(*) / 22500.0e0) AS mean FROM l3 GROUP BY ALL)"""
sql("clean_rents_like", LISTINGS, f"""SELECT s.row_id, s.key, s.place, s.area, s.kind, round_even({listed_base('mean')}, 0)::DOUBLE AS amount
 FROM l3 s JOIN lu m ON m.area IS NOT DISTINCT FROM s.area AND m.key IS NOT DISTINCT FROM s.key AND m.kind IS NOT DISTINCT FROM s.kind""")
sql("clean_own_model", """seg AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS option),
cu AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 3 = 1 THEN left(c_mktsegment, (3 + c_custkey % 4)::INT) ELSE c_mktsegment END AS shown FROM customer)""",
    "SELECT row_id, coalesce((SELECT min(option) FROM seg WHERE starts_with(option, upper(shown))), shown) AS shown FROM cu")
PART_CELLS = (("number", "number", False), ("name", "name", True), ("brand", "brand", False), ("type", "type.desc", True))
JOINT = f"""jr0 AS (SELECT {LINE_ID} AS row_id, p_partkey::VARCHAR AS true_number, p_name AS true_name, p_brand AS true_brand, p_type AS true_type FROM lineitem JOIN part ON p_partkey = l_partkey),
{typo_steps('jr0', 'true_name', 'name', 'jr1')},
{typo_steps('jr1', 'true_type', 'type', 'jr2')},
jr3 AS (SELECT row_id, CASE WHEN {u('missing.true_number')} >= 0.1e0 THEN true_number END AS number, name, CASE WHEN {u('missing.true_brand')} >= 0.1e0 THEN true_brand END AS brand, type FROM jr2),
jr AS (SELECT *, {ident(*[f"coalesce('=' || {c}, '?')" for c, _, _ in PART_CELLS])} AS tuple_id FROM jr3),
jt AS (SELECT tuple_id, {', '.join(f'any_value({c}) AS {c}' for c, _, _ in PART_CELLS)}, count(*) AS c FROM jr GROUP BY tuple_id),
jc AS ({' UNION ALL '.join(f"SELECT tuple_id, c, '{path}' AS path, {typos} AS typos, {c} AS observed FROM jt WHERE {c} IS NOT NULL" for c, path, typos in PART_CELLS)}),
jw AS (SELECT observed, path, sum(c)::BIGINT AS c FROM jc WHERE typos GROUP BY ALL),
{seeds('js', 'jw', 'observed', 'path', lo=1)},
jk AS (SELECT w.observed, w.path, v.entity_id, v.observed AS value, v.n, damerau_levenshtein(w.observed, v.observed) AS k FROM jw w JOIN js v ON v.path = w.path),
jl AS (SELECT *, ln(n - {D}) - ln((SELECT sum(n) FROM js)::DOUBLE + {S}) + {typo_loglik('k', 'value')} AS score FROM jk WHERE k <= 2),
{best('jb', 'jl', 'observed, path')},
cells AS (SELECT c.*, coalesce(b.value, c.observed) AS value FROM jc c LEFT JOIN jb b ON c.typos AND b.observed = c.observed AND b.path = c.path),
keys AS (SELECT tuple_id, {', '.join(f"max(value) FILTER (path = '{path}') AS {c}" for c, path, _ in PART_CELLS)} FROM cells GROUP BY tuple_id),
known AS (SELECT DISTINCT tuple_id, c FROM cells),
lk0 AS (SELECT tuple_id, {ident("'Part'", ident('number'))} AS entity_id FROM keys WHERE number IS NOT NULL),
vt AS (SELECT entity_id, path, value, sum(c)::DOUBLE AS score FROM cells JOIN lk0 USING (tuple_id) GROUP BY ALL),
{best('at0', 'vt', 'entity_id, path', 'score', 'value')},
sz AS (SELECT entity_id, sum(c)::BIGINT AS n FROM lk0 JOIN known USING (tuple_id) GROUP BY entity_id),
ek AS (SELECT entity_id, {', '.join(f"max(value) FILTER (path = '{path}') AS {c}" for c, path, _ in PART_CELLS)} FROM at0 GROUP BY entity_id),
cd AS (SELECT tuple_id, entity_id FROM keys k JOIN ek e ON k.number = e.number UNION SELECT tuple_id, entity_id FROM keys k JOIN ek e ON k.name = e.name AND k.brand = e.brand AND k.type = e.type),
ft AS (SELECT cd.tuple_id, cd.entity_id, sum(CASE WHEN a.value IS NULL THEN -length(c.observed) * ln(28.0e0) WHEN NOT c.typos THEN CASE WHEN a.value = c.observed THEN 0.0e0 ELSE -1.0e5 END
     WHEN damerau_levenshtein(c.observed, a.value) <= 2 THEN {typo_loglik('damerau_levenshtein(c.observed, a.value)', 'a.value')} ELSE -1.0e5 END) AS fit
   FROM cd JOIN cells c USING (tuple_id) LEFT JOIN at0 a ON a.entity_id = cd.entity_id AND a.path = c.path GROUP BY ALL),
sc AS (SELECT tuple_id, entity_id, fit + ln(n - {D}) - ln((SELECT sum(n) FROM sz)::DOUBLE + {S}) AS score FROM ft JOIN sz USING (entity_id)),
{best('ch', 'sc', 'tuple_id')},
lk1 AS (SELECT tuple_id, coalesce(ch.entity_id, {ident("'Part'", 'tuple_id')}) AS entity_id FROM known LEFT JOIN ch USING (tuple_id)),
vt1 AS (SELECT entity_id, path, value, sum(c)::DOUBLE AS score FROM cells JOIN lk1 USING (tuple_id) GROUP BY ALL),
{best('at1', 'vt1', 'entity_id, path', 'score', 'value')},
ek1 AS (SELECT entity_id, {', '.join(f"max(value) FILTER (path = '{path}') AS {c}" for c, path, _ in PART_CELLS)} FROM at1 GROUP BY entity_id)"""
sql("joint_repair", JOINT, f"SELECT f.row_id, {', '.join(f'coalesce(e.{c}, f.{c}) AS {c}' for c, _, _ in PART_CELLS)} FROM jr f LEFT JOIN lk1 USING (tuple_id) LEFT JOIN ek1 e ON e.entity_id = lk1.entity_id")
sql("repair_typos", f"{PARTS},\n{column_repair('rep', 'parts', 'p_name')}", f"SELECT row_id, repaired, {r('score')} AS score FROM rep")
SHORT = f"short0 AS (SELECT {ident('doc_id')} AS row_id, lang FROM documents),\n{typo_steps('short0', 'lang', 'shown', 'shorts')}"
sql("repair_typos_short", f"{SHORT},\n{column_repair('rep', 'shorts', 'shown')}", f"SELECT row_id, repaired, {r('score')} AS score FROM rep")
LONG = f"long0 AS (SELECT {ident('page_id')} AS row_id, url FROM pages),\n{typo_steps('long0', 'url', 'shown', 'longs')}"
sql("repair_typos_long", f"{LONG},\n{column_repair('rep', 'longs', 'shown')}", f"SELECT row_id, repaired, {r('score')} AS score FROM rep")
sql("candidates_long", f"{LONG}, pk AS (SELECT o.shown AS observed, w.url AS word, damerau_levenshtein(o.shown, w.url)::INT AS k FROM (SELECT DISTINCT shown FROM longs) o, (SELECT DISTINCT url FROM longs) w)", "SELECT observed, word, k FROM pk WHERE k <= 2")
sql("unit_correct", PRICES + f""", u0 AS (SELECT part, {base_of('1500.0e0')} AS base FROM prices),
um AS (SELECT part, (1500.0e0 / 1.0e6 + sum(base) / 22500.0e0) / (1.0e0 / 1.0e6 + count(*) / 22500.0e0) AS mean FROM u0 GROUP BY part)""",
    f"SELECT row_id, {unit_of('mean')} AS unit, round_even({base_of('mean')}, 0)::DOUBLE AS corrected FROM prices JOIN um USING (part)")
SUMS = "sum(error)::BIGINT AS errors, sum(changed)::BIGINT AS changed, sum(cleaned)::BIGINT AS cleaned, sum(imputed)::BIGINT AS imputed, sum(right_imputed)::BIGINT AS correctly_imputed"
sql("accuracy", f"{VERSIONS}, t AS (SELECT {SUMS} FROM flags)", f"SELECT *, {ratios()} FROM t")
N500 = ", ".join(f"coalesce(sum({c}) FILTER (row_no <= 500), 0)::BIGINT AS {n}" for c, n in [("changed", "changed"), ("cleaned", "cleaned"), ("imputed", "imputed"), ("right_imputed", "correctly_imputed")])
sql("accuracy_prefix", f"{VERSIONS}, t AS (SELECT sum(error)::BIGINT AS errors, sum(imputed)::BIGINT AS missing, {N500} FROM flags)", f"SELECT *, {ratios('missing')} FROM t")
sql("learning_curve", f"""{VERSIONS}, rw AS (SELECT row_no, sum(changed) AS a, sum(cleaned) AS b, sum(imputed) AS c, sum(right_imputed) AS e FROM flags GROUP BY row_no),
t AS (SELECT row_no, (SELECT sum(error) FROM flags) AS errors, (SELECT sum(imputed) FROM flags) AS missing, sum(a) OVER w AS changed, sum(b) OVER w AS cleaned, sum(c) OVER w AS imputed, sum(e) OVER w AS correctly_imputed
  FROM rw WINDOW w AS (ORDER BY row_no ROWS UNBOUNDED PRECEDING)), q AS (SELECT row_no, {ratios('missing')} FROM t)""", "SELECT row_no, f1 FROM q")
sql("error_report", VERSIONS, """SELECT col AS "column", CASE WHEN changed = 1 THEN 'changed' ELSE 'left' END AS kind, d AS dirty, o AS ours, k AS clean, count(*) AS n FROM flags
WHERE (changed = 1 AND coalesce(cleaned, 0) = 0) OR (error = 1 AND changed = 0) GROUP BY ALL""")
sql("refresh_batches", CLAIMS, "SELECT (rn // 10000)::BIGINT AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY row_id) AS rn FROM claims) GROUP BY ALL")

def streamed(where: str) -> str:
    """CTEs of three batches: links k{i} of batch i, made from entities s{i}; the prior is learned from what two batches left."""
    made = f"""{FLAT},
s0 AS (SELECT {ident('n_name', 'r_name')} AS entity_id, n_name AS nation, r_name AS region, 1::BIGINT AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE {where})"""
    for i in range(3):
        found = linked(f"k{i}", f"t{i}", f"s{i}")
        if i == 2:
            found = found.replace(f"ln(n - {D})", "ln(n - (SELECT discount FROM spy))").replace(f"::DOUBLE + {S})", "::DOUBLE + (SELECT strength FROM spy))")
            made += """,
sgr AS (SELECT s, d FROM (SELECT unnest([0.5e0, 1.0e0, 2.0e0, 4.0e0]) AS s), (SELECT unnest([0.0e0, 0.25e0, 0.5e0]) AS d)),
spa AS (SELECT s AS strength, d AS discount, (SELECT sum(ln(k * d + s)) FROM range((SELECT count(*) FROM s2)) t(k))
   + (SELECT sum(lgamma(n - d) - lgamma(1.0e0 - d)) FROM s2) - (lgamma((SELECT sum(n) FROM s2) + s) - lgamma(s)) AS score FROM sgr),
spy AS (SELECT * FROM spa ORDER BY round(score, 6) DESC, strength, discount LIMIT 1)"""
        made += f""",
t{i} AS (SELECT nation, region, count(*) AS c FROM flat WHERE floor({u('arrival')} * 3) = {i} GROUP BY ALL),
{found},
s{i + 1} AS (SELECT entity_id, min(nation) AS nation, min(region) AS region, sum(n)::BIGINT AS n FROM (SELECT entity_id, nation, region, n FROM s{i}
   UNION ALL SELECT entity_id, CASE WHEN is_new THEN nation END, CASE WHEN is_new THEN region END, c FROM k{i}) GROUP BY entity_id)"""
    return made


sql("stream_link", streamed("true"), " UNION ALL ".join(
    f"SELECT f.row_id, k.entity_id FROM flat f JOIN k{i} k ON {SAME.format('f', 'k')} WHERE floor({u('arrival', 'f.row_id')} * 3) = {i}" for i in range(3)))
sql("stream_entities", streamed("n_nationkey < 12"), "SELECT entity_id, nation, region, n FROM s3")

# --- injection --------------------------------------------------------------------------------------------------------------------

sql("inject_typos", PARTS, "SELECT row_id, clean_name AS clean, p_name AS dirty FROM parts")
sql("inject_swaps", CLAIMS, "SELECT row_id, truth AS clean, claim AS dirty FROM claims")
sql("inject_units", PRICES, "SELECT row_id, noisy AS clean, shown AS dirty FROM prices")
sql("inject_noise", PRICES, "SELECT row_id, truth AS clean, noisy AS dirty FROM prices")
sql("inject_name_forms", NAMES, "SELECT row_id, first || ' ' || middle || ' ' || last AS clean, shown AS dirty FROM names")
sql("inject_initials", NAMES, f"SELECT row_id, last AS clean, CASE WHEN {u('initial.last')} < 0.3e0 AND length(last) > 0 THEN last[1] || '.' ELSE last END AS dirty FROM names")
sql("inject_missing", PARTS, "SELECT row_id, clean_type AS clean, p_type AS dirty FROM parts")
sql("inject_expansions", SHORTS + f", ex AS (SELECT short, option, row_number() OVER (PARTITION BY short ORDER BY md5(short || '|' || option)) AS i, count(*) OVER (PARTITION BY short) AS n FROM (SELECT DISTINCT short FROM sh), so WHERE {subsequence('short', 'option')})",
    f"SELECT row_id, short AS clean, option AS dirty FROM sh JOIN ex USING (short) WHERE i = floor({u('expand.short')} * n) + 1")
