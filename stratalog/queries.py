"""Queries over the shared tables, each a program, and the same in SQL.

Every query reads whole tables; keys are 64 bits wide, so the programs are evaluated with ``number_bits=64`` except
where the wrapping of 32-bit numbers is what is shown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine

#: Declarations of the tables' columns that programs use: relation, table, (attribute, type, SQL) ...
TABLES = {
    "region": ("region", [("k", "number", "r_regionkey"), ("name", "symbol", "r_name")]),
    "nation": ("nation", [("k", "number", "n_nationkey"), ("name", "symbol", "n_name"), ("r", "number", "n_regionkey")]),
    "customer": ("customer", [("k", "number", "c_custkey"), ("n", "number", "c_nationkey"), ("seg", "symbol", "c_mktsegment")]),
    "supplier": ("supplier", [("k", "number", "s_suppkey"), ("n", "number", "s_nationkey")]),
    "part": ("part", [("k", "number", "p_partkey"), ("name", "symbol", "p_name"), ("brand", "symbol", "p_brand"), ("type", "symbol", "p_type"), ("size", "number", "p_size")]),
    "orders": ("orders", [("k", "number", "o_orderkey"), ("c", "number", "o_custkey"), ("status", "symbol", "o_orderstatus"), ("prio", "symbol", "o_orderpriority")]),
    "lineitem": ("lineitem", [("o", "number", "l_orderkey"), ("p", "number", "l_partkey"), ("s", "number", "l_suppkey"), ("line", "number", "l_linenumber"), ("flag", "symbol", "l_returnflag")]),
    "turn": ("conversations", [("conv", "number", "conv_id"), ("t", "number", "turn"), ("role", "symbol", "role")]),
    "event": ("events", [("id", "number", "event_id"), ("u", "number", "user_id"), ("type", "symbol", "event_type")]),
}


def _inputs(text: str) -> list[str]:
    import re

    used = set(re.findall(r"[A-Za-z_]+(?=\()", text))
    return [r for r in TABLES if r in used]


def _query(name: str, text: str, bits: int) -> Callable[[SparkSession, str], DataFrame]:
    names = _inputs(text)
    decls = "\n".join(f".decl {r}({', '.join(f'{a}:{t}' for a, t, _ in TABLES[r][1])}) input" for r in names)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine.from_source(f"{decls}\n{text}", spark, file=name, number_bits=bits)
        for r in names:
            table, columns = TABLES[r]
            engine.set_input(r, spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[c for _, _, c in columns]))
        return engine.run(["q"], lazy_outputs=True).df("q")

    run.__name__, run.__doc__ = name, text
    return run


_CHAIN = """
.decl next(a:number, b:number)
next(c*1000+t, c*1000+t+1) :- turn(c,t,_), turn(c,t+1,_).
"""
_CHAIN_SQL = "next AS (SELECT DISTINCT a.conv_id * 1000 + a.turn AS a, a.conv_id * 1000 + a.turn + 1 AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
_FLOW = """
.decl same(u:number, x:symbol, i:number)
same(u, x, i) :- event(i, u, x).
.decl flow(x:symbol, y:symbol)
flow(x, y) :- same(u, x, i), j = min k : { same(u, _, k), k > i }, same(u, y, j).
"""
_FLOW_SQL = "flow AS (SELECT DISTINCT x, y FROM (SELECT event_type AS x, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS y FROM events) WHERE y IS NOT NULL)"

_PROGRAMS: dict[str, tuple[str, str] | tuple[str, str, int] | tuple[str, None]] = {
    "projection_filter": (
        '.decl q(k:number, s:symbol) output q(k,s) :- customer(k,n,s), n = 3.',
        "SELECT DISTINCT c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_nationkey = 3",
    ),
    "constants_and_repeats": (
        '.decl q(k:number) output q(k) :- nation(k,_,k). q(k) :- nation(k,_,1), k != 2. q(7+2*3).',
        "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey = n_regionkey OR (n_regionkey = 1 AND n_nationkey <> 2) UNION SELECT 13::BIGINT",
    ),
    "equi_join_multiway": (
        '.decl q(c:number, nation:symbol, region:symbol) output q(c,n,r) :- customer(c,k,_), nation(k,n,g), region(g,r).',
        "SELECT DISTINCT c_custkey AS c, n_name AS nation, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    ),
    "self_join_neq": (
        '.decl q(a:number, b:number) output q(a,b) :- supplier(a,n), supplier(b,n), a != b.',
        "SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey",
    ),
    "theta_join": (
        '.decl ps(brand:symbol, size:number) ps(b,s) :- part(_,_,b,_,s). .decl q(brand:symbol, a:number, b:number) output q(b,x,y) :- ps(b,x), ps(b,y), x < y.',
        "SELECT DISTINCT a.p_brand AS brand, a.p_size::BIGINT AS a, b.p_size::BIGINT AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size < b.p_size",
    ),
    "expression_join": (
        '.decl q(o:number, p:number, p2:number) output q(o,p,p2) :- lineitem(o,p,_,i,_), lineitem(o,p2,_,i+1,_).',
        "SELECT DISTINCT a.l_orderkey AS o, a.l_partkey AS p, b.l_partkey AS p2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1",
    ),
    "cross_product": (
        '.decl q(r:symbol, n:symbol) output q(r,n) :- region(_,r), nation(_,n,_).',
        "SELECT DISTINCT r_name AS r, n_name AS n FROM region, nation",
    ),
    "semi_join": (
        '.decl q(c:number) output q(c) :- customer(c,_,_), orders(_,c,_,_).',
        "SELECT DISTINCT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    ),
    "existence_scan": (
        '.decl q(n:symbol) output q(n) :- nation(_,n,_), orders(_,_,"F",_).',
        "SELECT DISTINCT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F')",
    ),
    "anti_join": (
        '.decl urgent(c:number) urgent(c) :- orders(_,c,"F","1-URGENT"). .decl q(c:number) output q(c) :- customer(c,_,_), !urgent(c).',
        "SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')",
    ),
    "partial_anti_join": (
        '.decl q(p:number) output q(p) :- part(p,_,_,_,_), !lineitem(_,p,_,1,"R").',
        "SELECT DISTINCT p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber = 1 AND l_returnflag = 'R')",
    ),
    "expression_anti_join": (
        '.decl q(o:number, i:number) output q(o,i) :- lineitem(o,_,_,i,_), !lineitem(o,_,_,i+1,_).',
        "SELECT DISTINCT l_orderkey AS o, l_linenumber::BIGINT AS i FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)",
    ),
    "constant_anti_join": (
        '.decl q(x:symbol) output q("no such region") :- region(_,_), !region(_,"ATLANTIS"). q("no europe") :- region(_,_), !region(_,"EUROPE").',
        "SELECT 'no such region' AS x WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_name = 'ATLANTIS') UNION SELECT 'no europe' WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_name = 'EUROPE')",
    ),
    "union_sets": (
        '.decl q(n:number) output q(n) :- customer(_,n,_). q(n) :- supplier(_,n).',
        "SELECT c_nationkey::BIGINT AS n FROM customer UNION SELECT s_nationkey::BIGINT FROM supplier",
    ),
    "intersect_sets": (
        '.decl q(n:number) output q(n) :- customer(_,n,"BUILDING"), supplier(_,n).',
        "SELECT c_nationkey::BIGINT AS n FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT s_nationkey::BIGINT FROM supplier",
    ),
    "except_sets": (
        '.decl s(n:number) s(n) :- supplier(k,n), k % 7 = 0. .decl q(n:number) output q(n) :- customer(_,n,_), !s(n).',
        "SELECT c_nationkey::BIGINT AS n FROM customer EXCEPT SELECT s_nationkey::BIGINT FROM supplier WHERE s_suppkey % 7 = 0",
    ),
    "agg_count_zero": (
        '.decl q(c:number, n:number) output q(c,n) :- customer(c,_,_), n = count : orders(_,c,_,_).',
        "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "agg_count_whole": (
        '.decl q(n:number) output q(count : nation(_,_,_)) :- region(_,_).',
        "SELECT count(*) AS n FROM nation",
    ),
    "agg_min_max_corr": (
        '.decl q(b:symbol, lo:number, hi:number) output q(b,lo,hi) :- part(_,_,b,_,_), lo = min s : part(_,_,b,_,s), hi = max s : part(_,_,b,_,s).',
        "SELECT p_brand AS b, min(p_size)::BIGINT AS lo, max(p_size)::BIGINT AS hi FROM part GROUP BY 1",
    ),
    "agg_body_theta": (
        '.decl q(r:symbol, m:number) output q(r, m) :- region(g,r), m = max c + s : { nation(n,_,g), customer(c,n,_), supplier(s,n), c > s }.',
        "SELECT r_name AS r, max(c_custkey + s_suppkey) AS m FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey AND c_custkey > s_suppkey GROUP BY 1",
    ),
    "agg_empty_min_fails": (
        '.decl q(x:symbol, n:number) output q("count", n) :- n = count : region(_,"ATLANTIS"). q("min", m) :- m = min k : region(k,"ATLANTIS").',
        "SELECT 'count' AS x, 0::BIGINT AS n",
    ),
    "agg_in_expression": (
        '.decl q(k:number, d:number) output q(k, d) :- part(k,_,_,_,s), d = 2 * (max t : part(_,_,_,_,t)) - s.',
        "SELECT DISTINCT p_partkey AS k, (2 * (SELECT max(p_size) FROM part) - p_size)::BIGINT AS d FROM part",
    ),
    "tc_linear": (
        _CHAIN + '.decl q(a:number, b:number) output q(a,b) :- next(a,b). q(a,c) :- q(a,b), next(b,c).',
        f"WITH RECURSIVE {_CHAIN_SQL}, q AS (SELECT a, b FROM next UNION SELECT q.a, next.b FROM q JOIN next ON q.b = next.a) SELECT a, b FROM q",
    ),
    "tc_right": (
        _CHAIN + '.decl q(a:number, b:number) output q(a,b) :- next(a,b). q(a,c) :- next(a,b), q(b,c).',
        f"WITH RECURSIVE {_CHAIN_SQL}, q AS (SELECT a, b FROM next UNION SELECT q.a, next.b FROM q JOIN next ON q.b = next.a) SELECT a, b FROM q",
    ),
    "tc_quadratic": (
        _CHAIN + '.decl q(a:number, b:number) output q(a,b) :- next(a,b). q(a,c) :- q(a,b), q(b,c).',
        f"WITH RECURSIVE {_CHAIN_SQL}, q AS (SELECT a, b FROM next UNION SELECT q.a, next.b FROM q JOIN next ON q.b = next.a) SELECT a, b FROM q",
    ),
    "event_reach": (
        _FLOW + '.decl q(a:symbol, b:symbol) output q(a,b) :- flow(a,b). q(a,c) :- q(a,b), flow(b,c).',
        f"WITH RECURSIVE {_FLOW_SQL}, q AS (SELECT x AS a, y AS b FROM flow UNION SELECT q.a, flow.y FROM q JOIN flow ON q.b = flow.x) SELECT a, b FROM q",
    ),
    "same_generation": (
        '''.decl up(c:symbol, p:symbol) up(cat("s",cat("-",n)), cat("n-",n)) :- supplier(_,k), nation(k,n,_). up(cat("c-",cat(seg,n)), cat("n-",n)) :- customer(_,k,seg), nation(k,n,_). up(cat("n-",n), r) :- nation(_,n,g), region(g,r).
        .decl q(a:symbol, b:symbol) output q(a,b) :- up(a,p), up(b,p). q(a,b) :- up(a,x), q(x,y), up(b,y).''',
        """WITH RECURSIVE up AS (SELECT 's-' || n_name AS c, 'n-' || n_name AS p FROM supplier JOIN nation ON n_nationkey = s_nationkey
          UNION SELECT 'c-' || c_mktsegment || n_name, 'n-' || n_name FROM customer JOIN nation ON n_nationkey = c_nationkey
          UNION SELECT 'n-' || n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey),
        q AS (SELECT x.c AS a, y.c AS b FROM up x JOIN up y ON x.p = y.p UNION SELECT x.c, y.c FROM q JOIN up x ON x.p = q.a JOIN up y ON y.p = q.b) SELECT a, b FROM q""",
    ),
    "mutual_recursion": (
        _CHAIN + '.decl odd(a:number, b:number) .decl even(a:number, b:number) odd(a,b) :- next(a,b). even(a,c) :- odd(a,b), next(b,c). odd(a,c) :- even(a,b), next(b,c). .decl q(a:number, b:number, p:symbol) output q(a,b,"odd") :- odd(a,b). q(a,b,"even") :- even(a,b).',
        f"WITH RECURSIVE {_CHAIN_SQL}, r AS (SELECT a, b, 1 AS k FROM next UNION SELECT r.a, next.b, 1 - k FROM r JOIN next ON r.b = next.a) SELECT a, b, CASE k WHEN 1 THEN 'odd' ELSE 'even' END AS p FROM r",
    ),
    "stratified_neg_recursion": (
        '.decl step(a:symbol, b:symbol) step(n,m) :- nation(k,n,g), nation(k+1,m,g). .decl reach(a:symbol, b:symbol) reach(a,b) :- step(a,b). reach(a,c) :- reach(a,b), step(b,c). .decl q(a:symbol, b:symbol) output q(a,b) :- nation(_,a,_), nation(_,b,_), !reach(a,b).',
        """WITH RECURSIVE step AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 AND a.n_regionkey = b.n_regionkey),
        reach AS (SELECT a, b FROM step UNION SELECT reach.a, step.b FROM reach JOIN step ON reach.b = step.a)
        SELECT x.n_name AS a, y.n_name AS b FROM nation x, nation y EXCEPT SELECT a, b FROM reach""",
    ),
    "bounded_generation": (
        '.decl q(n:number, f:number) output q(0,1). q(n+1, f*(n+1)) :- q(n,f), n < max k : nation(k,_,_), n < 15.',
        "WITH RECURSIVE q AS (SELECT 0::BIGINT AS n, 1::BIGINT AS f UNION SELECT n + 1, f * (n + 1) FROM q WHERE n < (SELECT max(n_nationkey) FROM nation) AND n < 15) SELECT n, f FROM q",
    ),
    "arithmetic": (
        '.decl q(k:number, a:number, b:number, c:number, d:number, e:number) output q(k, s+k*2-1, -s/3, -s%3, s^2, -(s-5)) :- part(k,_,_,_,s).',
        "SELECT DISTINCT p_partkey AS k, p_size + p_partkey * 2 - 1 AS a, -(p_size // 3)::BIGINT AS b, -(p_size % 3)::BIGINT AS c, (p_size * p_size)::BIGINT AS d, (5 - p_size)::BIGINT AS e FROM part",
    ),
    "wrapping": (
        '.decl q(s:number, x:number, y:number) output q(s, s*100000007, s^7) :- part(_,_,_,_,s), s <= 20.',
        "SELECT DISTINCT p_size AS s, (((p_size::BIGINT * 100000007 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::INTEGER AS x, (((power(p_size, 7)::BIGINT + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::INTEGER AS y FROM part WHERE p_size <= 20",
        32,
    ),
    "comparisons": (
        '.decl n(x:number) n(s) :- part(_,_,_,_,s). .decl q(op:symbol, x:number, y:number) output q("<",x,y) :- n(x),n(y),x<y. q("<=",x,y) :- n(x),n(y),x<=y. q(">",x,y) :- n(x),n(y),x>y. q(">=",x,y) :- n(x),n(y),x>=y. q("=",x,y) :- n(x),n(y),x=y. q("!=",x,y) :- n(x),n(y),x!=y.',
        "WITH n AS (SELECT DISTINCT p_size::BIGINT AS v FROM part), p AS (SELECT a.v AS x, b.v AS y FROM n a, n b) SELECT '<' AS op, x, y FROM p WHERE x < y UNION ALL SELECT '<=', x, y FROM p WHERE x <= y UNION ALL SELECT '>', x, y FROM p WHERE x > y UNION ALL SELECT '>=', x, y FROM p WHERE x >= y UNION ALL SELECT '=', x, y FROM p WHERE x = y UNION ALL SELECT '!=', x, y FROM p WHERE x <> y",
    ),
    "cat": (
        '.decl q(k:number, s:symbol) output q(k, cat(b, cat("/", n))) :- part(k,n,b,_,_).',
        "SELECT DISTINCT p_partkey AS k, p_brand || '/' || p_name AS s FROM part",
    ),
    "match": (
        '.decl q(k:number) output q(k) :- part(k,n,_,_,_), match("(red|blue) [a-m].*", n).',
        "SELECT DISTINCT p_partkey AS k FROM part WHERE regexp_full_match(p_name, '(red|blue) [a-m].*')",
    ),
    "match_column": (
        '.decl pat(p:symbol) pat(".*_1[0-9]"). pat("NATION_[2-5]"). pat("b.*["). .decl q(p:symbol, n:symbol) output q(p,n) :- nation(_,n,_), pat(p), match(p,n).',
        "SELECT p, n_name AS n FROM nation, (SELECT unnest(['.*_1[0-9]', 'NATION_[2-5]']) AS p) WHERE regexp_full_match(n_name, p)",
    ),
    "contains": (
        '.decl q(seg:symbol) output q(s) :- customer(_,_,s), contains("IL", s).',
        "SELECT DISTINCT c_mktsegment AS seg FROM customer WHERE contains(c_mktsegment, 'IL')",
    ),
    "record_roundtrip": (
        '.type P = [b:symbol, s:number] .decl packed(k:number, p:P) packed(k,[b,s]) :- part(k,_,b,_,s). .decl q(k:number, b:symbol, s:number) output q(k,b,s) :- packed(k,[b,s]), s > 10. q(k,b,0) :- packed(k,p), p = [b,_], p != nil, k < 10.',
        "SELECT p_partkey AS k, p_brand AS b, p_size::BIGINT AS s FROM part WHERE p_size > 10 UNION SELECT p_partkey, p_brand, 0 FROM part WHERE p_partkey < 10",
    ),
    "record_lists": (
        '.type L = [head:symbol, tail:L] .decl path(n:number, l:L) path(k, [n, nil]) :- nation(k,n,_), k % 5 = 0. path(k, [n, l]) :- path(j, l), nation(k,n,_), k = j + 1, k % 5 != 0. .decl q(a:symbol, b:symbol) output q(a,b) :- path(_, [a, [b, _]]).',
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey + 1 WHERE a.n_nationkey % 5 <> 0",
    ),
    "subtypes": (
        '.type Nation .type Region .type Place = Nation | Region .decl n(x:Nation) .decl r(x:Region) n(x) :- nation(_,x,_). r(x) :- region(_,x). .decl q(x:Place) output q(x) :- n(x). q(x) :- r(x).',
        "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region",
    ),
    "component_instantiation": (
        '''.comp Closure<T> { .decl edge(a:T, b:T) .decl reach(a:T, b:T) reach(a,b) :- edge(a,b). reach(a,c) :- reach(a,b), edge(b,c). }
        .init num = Closure<number> .init sym = Closure<symbol>
        num.edge(k,k+1) :- nation(k,_,g), nation(k+1,_,g). sym.edge(n,r) :- nation(_,n,g), region(g,r).
        .decl q(a:symbol, b:symbol) output q(x,y) :- num.reach(a,b), nation(a,x,_), nation(b,y,_). q(x,y) :- sym.reach(x,y).''',
        """WITH RECURSIVE e AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 AND a.n_regionkey = b.n_regionkey),
        t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
        SELECT x.n_name AS a, y.n_name AS b FROM t JOIN nation x ON x.n_nationkey = t.a JOIN nation y ON y.n_nationkey = t.b UNION SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey""",
    ),
    "component_override": (
        '''.comp Base { .decl pick(n:symbol) overridable pick(n) :- nation(_,n,0). .decl out(n:symbol) out(n) :- pick(n). }
        .comp Other : Base { .override pick pick(n) :- nation(_,n,1). }
        .init a = Base .init b = Other .decl q(w:symbol, n:symbol) output q("a",n) :- a.out(n). q("b",n) :- b.out(n).''',
        "SELECT CASE n_regionkey WHEN 0 THEN 'a' ELSE 'b' END AS w, n_name AS n FROM nation WHERE n_regionkey IN (0, 1)",
    ),
    "plan_and_strict": (
        '.decl q(c:number, r:symbol) output q(c,r) :- region(g,r), customer(c,n,_), nation(n,_,g). .plan 0:(2,3,1) q(c,r) :- supplier(c,n), nation(n,_,g), region(g,r). .strict',
        "SELECT c_custkey AS c, r_name AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION SELECT s_suppkey, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
    ),
    "preprocessor": (
        '#define SIZE 25\n#ifdef SIZE\n/* kept */ .decl q(k:number) output q(k) :- part(k,_,_,_,SIZE). // all of that size\n#else\n.decl q(k:symbol) output\n#endif',
        "SELECT DISTINCT p_partkey AS k FROM part WHERE p_size = 25",
    ),
    "ordinals": ('.decl q(a:symbol, b:symbol) output q(a,b) :- region(_,a), region(_,b), ord(a) != ord(b).', "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name <> b.r_name"),
    "counter": ('.decl id(n:symbol, i:number) id(n,$) :- nation(_,n,_). .decl q(n:symbol, m:symbol) output q(n,m) :- id(n,i), id(m,i).', "SELECT n_name AS n, n_name AS m FROM nation"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(n, p[0], p[2] if len(p) > 2 else 64) for n, p in _PROGRAMS.items()}
CHECK_SQL: dict[str, str] = {n: p[1] for n, p in _PROGRAMS.items() if p[1]}
