"""Queries over the driver's tables, one or more for each operator, each with the SQL that gives the same rows.

Names, then SPARQL (prefix : is <urn:t:>), then SQL. SQL None: random or time-dependent results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.engine import Engine
from graphloom.operators.written import shared_root
from graphloom.sources.mapped import MappedSource, warehouse
from graphloom.sources.quads import QuadTableSource
from graphloom.store import Store
from graphloom.terms import IRI, Literal, term_of

PREFIXES = {"": "urn:t:", "g": "urn:g:", "xsd": "http://www.w3.org/2001/XMLSchema#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}
CATALOG: dict[str, tuple[str, str | None]] = {}


def add(name: str, sparql: str, sql: str | None) -> None:
    CATALOG[name] = (sparql, sql)


# Patterns, projection, filters
add("bgp_star", "SELECT ?k ?st ?p WHERE { ?o :o_orderkey ?x ; :o_orderstatus ?st ; :o_totalprice ?p ; :o_orderpriority ?k }", "SELECT o_orderpriority AS k, o_orderstatus AS st, o_totalprice AS p FROM orders")
add("bgp_subject", "SELECT ?o ?st WHERE { ?o :o_orderstatus ?st }", "SELECT 'urn:t:orders/' || o_orderkey AS o, o_orderstatus AS st FROM orders")
add("bgp_join_2", "SELECT ?n ?p WHERE { ?o :o_totalprice ?p ; :o_custkey ?c . ?c :c_name ?n }", "SELECT c_name AS n, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey")
add("bgp_join_3", "SELECT ?q ?n ?p WHERE { ?l :l_quantity ?q ; :l_orderkey ?o . ?o :o_custkey ?c ; :o_totalprice ?p . ?c :c_name ?n . FILTER(?q >= 49) }", "SELECT l_quantity AS q, c_name AS n, o_totalprice AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 49")
add("bgp_join_5", "SELECT ?r (COUNT(*) AS ?n) WHERE { ?l :l_orderkey ?o . ?o :o_custkey ?c . ?c :c_nationkey ?na . ?na :n_regionkey ?re . ?re :r_name ?r } GROUP BY ?r", "SELECT r_name AS r, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("bgp_constant_subject", "SELECT ?n ?b WHERE { <urn:t:customer/7> :c_name ?n ; :c_acctbal ?b }", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey = 7")
add("bgp_constant_object", "SELECT ?n WHERE { ?c :c_nationkey <urn:t:nation/3> ; :c_name ?n }", "SELECT c_name AS n FROM customer WHERE c_nationkey = 3")
add("bgp_unknown", "SELECT ?x WHERE { ?x :no_such_thing ?y }", "SELECT CAST(NULL AS VARCHAR) AS x WHERE false")
add("filter_cmp", "SELECT ?n ?s ?p WHERE { ?x :p_name ?n ; :p_size ?s ; :p_retailprice ?p . FILTER(?s > 10) FILTER(?s <= 20) FILTER(?p < 1500) FILTER(?p >= 950.5) FILTER(?s != 15) }", "SELECT p_name AS n, p_size AS s, p_retailprice AS p FROM part WHERE p_size > 10 AND p_size <= 20 AND p_retailprice < 1500 AND p_retailprice >= 950.5 AND p_size <> 15")
add("filter_logic", "SELECT ?n ?b WHERE { ?c :c_name ?n ; :c_acctbal ?b ; :c_mktsegment ?m . FILTER((?b < 0 || ?m = 'BUILDING') && !(?b > 5000)) }", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE (c_acctbal < 0 OR c_mktsegment = 'BUILDING') AND NOT c_acctbal > 5000")
add("filter_in", "SELECT ?n ?s WHERE { ?x :p_name ?n ; :p_size ?s . FILTER(?s IN (1, 5, 9)) }", "SELECT p_name AS n, p_size AS s FROM part WHERE p_size IN (1, 5, 9)")
add("filter_not_in", "SELECT ?n ?m WHERE { ?c :c_name ?n ; :c_mktsegment ?m . FILTER(?m NOT IN ('BUILDING', 'MACHINERY')) }", "SELECT c_name AS n, c_mktsegment AS m FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
add("filter_date", "SELECT (COUNT(*) AS ?n) WHERE { ?l :l_shipdate ?d . FILTER(?d >= '1995-01-01T00:00:00'^^xsd:dateTime && ?d < '1996-01-01T00:00:00'^^xsd:dateTime) }", "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01'")
add("repeated_var", "SELECT ?o ?k WHERE { ?l :l_linenumber ?k ; :l_quantity ?q ; :l_orderkey ?o . FILTER(?k = ?q) }", "SELECT 'urn:t:orders/' || l_orderkey AS o, l_linenumber AS k FROM lineitem WHERE l_linenumber = l_quantity")
add("repeated_var_in_bgp", "SELECT ?x WHERE { ?n :n_nationkey ?x ; :n_nationkey ?x . ?r :r_regionkey ?x }", "SELECT n_nationkey AS x FROM nation JOIN region ON n_nationkey = r_regionkey")
add("same_foreign_key", "SELECT (COUNT(*) AS ?n) WHERE { ?s :s_nationkey ?k . ?c :c_nationkey ?k }", "SELECT count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey")
add("var_predicate", "SELECT ?p (COUNT(*) AS ?n) WHERE { GRAPH g:customer { ?s ?p ?o } } GROUP BY ?p", "SELECT p, count(*) AS n FROM (SELECT unnest(['urn:t:c_custkey','urn:t:c_name','urn:t:c_nationkey','urn:t:c_acctbal','urn:t:c_mktsegment','http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p FROM customer) GROUP BY 1")
add("var_predicate_of_subject", "SELECT ?p ?o WHERE { <urn:t:nation/4> ?p ?o }", "SELECT unnest(['urn:t:n_nationkey','urn:t:n_name','urn:t:n_regionkey','http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p, unnest([CAST(n_nationkey AS VARCHAR), n_name, 'urn:t:region/' || n_regionkey, 'urn:t:nation']) AS o FROM nation WHERE n_nationkey = 4")
add("class_variable", "SELECT ?c (COUNT(*) AS ?n) WHERE { ?s a ?c . FILTER(?c IN (:nation, :region, :supplier)) } GROUP BY ?c", "SELECT 'urn:t:nation' AS c, count(*) AS n FROM nation UNION ALL SELECT 'urn:t:region', count(*) FROM region UNION ALL SELECT 'urn:t:supplier', count(*) FROM supplier")
add("empty_bgp", "SELECT (1 AS ?one) WHERE { }", "SELECT CAST(1 AS BIGINT) AS one")
# Optional, union, minus, exists
add("optional", "SELECT ?d ?q WHERE { ?d a :documents . OPTIONAL { ?d :labels_quality ?q } }", "SELECT 'urn:t:documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
add("optional_filter", "SELECT ?n ?p WHERE { ?c :c_name ?n ; :c_acctbal ?b . OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?p . FILTER(?p > 400000 && ?b > 0) } }", "SELECT c_name AS n, o_totalprice AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 AND c_acctbal > 0")
add("optional_nested", "SELECT ?n ?x ?y WHERE { ?r :r_name ?n . OPTIONAL { ?k :n_regionkey ?r ; :n_name ?x . OPTIONAL { ?s :s_nationkey ?k ; :s_name ?y . ?s :s_acctbal ?b FILTER(?b > 9000) } } }", "SELECT r_name AS n, n_name AS x, s_name AS y FROM region LEFT JOIN (nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000) ON n_regionkey = r_regionkey")
add("optional_unbound", "SELECT ?d WHERE { ?d a :documents . OPTIONAL { ?d :labels_quality ?q } FILTER(!BOUND(?q)) }", "SELECT 'urn:t:documents/' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
add("optional_disjoint", "SELECT ?r ?x WHERE { ?a :r_name ?r . OPTIONAL { ?b :n_nationkey ?x . FILTER(?x < 2) } }", "SELECT r_name AS r, n_nationkey AS x FROM region LEFT JOIN nation ON n_nationkey < 2")
add("compat_join", "SELECT ?d ?q ?y WHERE { ?d :documents_source 'src3' . OPTIONAL { ?d :labels_quality ?q } { SELECT ?q (COUNT(*) AS ?y) WHERE { ?e :labels_quality ?q } GROUP BY ?q } }", "WITH k AS (SELECT quality AS q, count(*) AS y FROM labels GROUP BY 1) SELECT 'urn:t:documents/' || d.doc_id AS d, k.q AS q, y FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id JOIN k ON l.quality IS NULL OR l.quality = k.q WHERE source = 'src3'")
add("compat_optional", "SELECT ?d ?q ?n WHERE { ?d :documents_source 'src4' . OPTIONAL { ?d :labels_quality ?q } OPTIONAL { ?x :r_regionkey ?q ; :r_name ?n } }", "SELECT 'urn:t:documents/' || d.doc_id AS d, coalesce(l.quality, r_regionkey) AS q, r_name AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN region ON l.quality IS NULL OR l.quality = r_regionkey WHERE source = 'src4'")
add("union", "SELECT ?n WHERE { { ?c :c_name ?n } UNION { ?s :s_name ?n } }", "SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier")
add("union_missing_vars", "SELECT ?c ?s WHERE { { ?x :c_name ?c } UNION { ?y :s_name ?s } }", "SELECT c_name AS c, NULL AS s FROM customer UNION ALL SELECT NULL, s_name FROM supplier")
add("union_mixed_types", "SELECT ?v WHERE { { ?x :p_size ?v . FILTER(?v < 5) } UNION { ?y :r_name ?v } }", "SELECT CAST(p_size AS VARCHAR) AS v FROM part WHERE p_size < 5 UNION ALL SELECT r_name FROM region")
add("minus", "SELECT ?d WHERE { ?d a :documents MINUS { ?d :labels_toxic 1 } }", "SELECT 'urn:t:documents/' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
add("minus_disjoint", "SELECT ?n WHERE { ?r :r_name ?n MINUS { ?x :n_name ?y } }", "SELECT r_name AS n FROM region")
add("minus_nullable", "SELECT ?d ?q WHERE { ?d :documents_source 'src5' . OPTIONAL { ?d :labels_quality ?q } MINUS { ?e :labels_quality ?q . FILTER(?q = 0) } }", "SELECT 'urn:t:documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE source = 'src5' AND (quality IS NULL OR quality <> 0)")
add("exists", "SELECT ?n WHERE { ?c :c_name ?n . FILTER EXISTS { ?o :o_custkey ?c ; :o_orderstatus 'F' } }", "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
add("not_exists", "SELECT ?n WHERE { ?c :c_name ?n . FILTER NOT EXISTS { ?o :o_custkey ?c ; :o_totalprice ?p . FILTER(?p > 300000) } }", "SELECT c_name AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
add("optional_exists", "SELECT ?n ?x WHERE { ?r :r_name ?n . VALUES ?z { 1 2 } OPTIONAL { ?k :n_regionkey ?r ; :n_name ?x . FILTER EXISTS { ?s :s_nationkey ?k ; :s_acctbal ?b . FILTER(?b > 8000) } } }", "SELECT r_name AS n, n_name AS x FROM region CROSS JOIN (VALUES (1), (2)) LEFT JOIN nation ON n_regionkey = r_regionkey AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 8000)")
add("exists_outer_bind", "SELECT ?n WHERE { ?c :c_name ?n ; :c_acctbal ?b . FILTER EXISTS { ?o :o_custkey ?c ; :o_totalprice ?p . BIND(?b * 40 AS ?f) FILTER(?p > ?f) FILTER(?f > 0) } }", "SELECT c_name AS n FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)")
add("exists_outer_union", "SELECT ?n WHERE { ?c :c_name ?n ; :c_acctbal ?b . FILTER EXISTS { { ?o :o_custkey ?c ; :o_totalprice ?p . FILTER(?p > ?b * 45) } UNION { ?o :o_custkey ?c ; :o_orderstatus 'P' . FILTER(?b < 0) } } }", "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_totalprice > c_acctbal * 45 OR o_orderstatus = 'P' AND c_acctbal < 0))")
add("not_exists_outer_nested", "SELECT ?n WHERE { ?c :c_name ?n ; :c_acctbal ?b . FILTER NOT EXISTS { ?o :o_custkey ?c FILTER EXISTS { ?l :l_orderkey ?o ; :l_extendedprice ?e . FILTER(?e > ?b * 9) } } }", "SELECT c_name AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > c_acctbal * 9))")
add("distinct_order_unselected", "SELECT DISTINCT ?n WHERE { ?c :c_nationkey ?k ; :c_acctbal ?b . ?k :n_name ?n } ORDER BY DESC(?b) LIMIT 5", "SELECT n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY max(c_acctbal) DESC LIMIT 5")
add("distinct_order_exists", "SELECT DISTINCT ?n WHERE { ?k :n_name ?n } ORDER BY (EXISTS { ?s :s_nationkey ?k ; :s_acctbal ?b . FILTER(?b > 8000) }) ?n LIMIT 7", "SELECT n_name AS n FROM nation ORDER BY EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 8000), 1 LIMIT 7")
add("exists_outer_filter", "SELECT ?n WHERE { ?c :c_name ?n ; :c_acctbal ?b . FILTER EXISTS { ?o :o_custkey ?c ; :o_totalprice ?p . FILTER(?p > ?b * 45) } }", "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 45)")
add("exists_in_or", "SELECT ?n WHERE { ?c :c_name ?n ; :c_acctbal ?b . FILTER(?b > 9000 || EXISTS { ?o :o_custkey ?c ; :o_orderpriority '1-URGENT' }) }", "SELECT c_name AS n FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
add("exists_disjoint", "SELECT ?n WHERE { ?r :r_name ?n . FILTER EXISTS { ?p :p_size 3 } FILTER NOT EXISTS { ?p :p_size -1 } }", "SELECT r_name AS n FROM region WHERE EXISTS (SELECT 1 FROM part WHERE p_size = 3)")
# Values, bind, subqueries, modifiers
add("values", "SELECT ?n ?s WHERE { VALUES ?s { 1 2 3 } ?x :p_size ?s ; :p_name ?n }", "SELECT p_name AS n, p_size AS s FROM part WHERE p_size IN (1, 2, 3)")
add("values_undef", "SELECT ?n ?m WHERE { VALUES (?m ?n) { ('BUILDING' UNDEF) (UNDEF 'Customer#000000007') } ?c :c_mktsegment ?m ; :c_name ?n }", "SELECT c_name AS n, c_mktsegment AS m FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_name, c_mktsegment FROM customer WHERE c_name = 'Customer#000000007'")
add("values_iri", "SELECT ?k ?n WHERE { VALUES ?k { <urn:t:nation/1> <urn:t:nation/5> <urn:t:region/1> } ?k :n_name ?n }", "SELECT 'urn:t:nation/' || n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey IN (1, 5)")
add("values_after", "SELECT ?n WHERE { ?r :r_name ?n } VALUES ?n { 'ASIA' 'EUROPE' 'MARS' }", "SELECT r_name AS n FROM region WHERE r_name IN ('ASIA', 'EUROPE')")
add("bind", "SELECT ?n ?v WHERE { ?x :p_name ?n ; :p_size ?s ; :p_retailprice ?p . BIND(?s * 2 + 1 AS ?v) }", "SELECT p_name AS n, CAST(p_size * 2 + 1 AS BIGINT) AS v FROM part")
add("bind_error", "SELECT ?n ?v WHERE { ?x :r_name ?n . BIND(?n + 1 AS ?v) }", "SELECT r_name AS n, CAST(NULL AS VARCHAR) AS v FROM region")
add("bind_division", "SELECT ?k ?v WHERE { ?x :n_nationkey ?k . BIND(ROUND(xsd:double(12 / (?k - 3)) * 1000000) / 1000000 AS ?v) }", "SELECT n_nationkey AS k, CASE WHEN n_nationkey <> 3 THEN floor(12::DOUBLE / (n_nationkey - 3) * 1000000 + 0.5) / 1000000 END AS v FROM nation")
add("subselect", "SELECT ?n ?t WHERE { ?c :c_name ?n . { SELECT ?c (COUNT(*) AS ?t) WHERE { ?o :o_custkey ?c } GROUP BY ?c } FILTER(?t > 12) }", "SELECT c_name AS n, t FROM customer JOIN (SELECT o_custkey, count(*) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE t > 12")
add("subselect_limit", "SELECT ?n ?p WHERE { { SELECT ?o ?p WHERE { ?o :o_totalprice ?p ; :o_orderkey ?k } ORDER BY DESC(?p) ?k LIMIT 10 } ?o :o_custkey ?c . ?c :c_name ?n }", "SELECT c_name AS n, p FROM (SELECT o_custkey, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) JOIN customer ON o_custkey = c_custkey")
add("subselect_scope", "SELECT ?n WHERE { ?r :r_name ?n . { SELECT (COUNT(*) AS ?k) WHERE { ?x :n_name ?n } } }", "SELECT r_name AS n FROM region")
add("distinct", "SELECT DISTINCT ?m ?k WHERE { ?c :c_mktsegment ?m ; :c_nationkey ?k }", "SELECT DISTINCT c_mktsegment AS m, 'urn:t:nation/' || c_nationkey AS k FROM customer")
add("reduced", "SELECT REDUCED ?n WHERE { ?r :r_name ?n }", "SELECT r_name AS n FROM region")
add("order_multi", "SELECT ?m ?n WHERE { ?c :c_mktsegment ?m ; :c_name ?n } ORDER BY DESC(?m) ?n", "SELECT c_mktsegment AS m, c_name AS n FROM customer")
add("order_slice", "SELECT ?m ?n WHERE { ?c :c_mktsegment ?m ; :c_name ?n } ORDER BY DESC(?m) ?n OFFSET 3 LIMIT 40", "SELECT c_mktsegment AS m, c_name AS n FROM customer ORDER BY m DESC, n LIMIT 40 OFFSET 3")
add("order_unbound_first", "SELECT ?d ?q WHERE { ?d a :documents ; :documents_doc_id ?i . OPTIONAL { ?d :labels_quality ?q } } ORDER BY ?q ?i LIMIT 30", "SELECT 'urn:t:documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality NULLS FIRST, d.doc_id LIMIT 30")
add("topk", "SELECT ?o ?p WHERE { ?o :o_totalprice ?p ; :o_orderkey ?k } ORDER BY DESC(?p) ?k LIMIT 20", "SELECT 'urn:t:orders/' || o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
add("distinct_order", "SELECT DISTINCT ?s WHERE { ?x :p_size ?s } ORDER BY DESC(?s) LIMIT 7", "SELECT DISTINCT p_size AS s FROM part ORDER BY 1 DESC LIMIT 7")
# Aggregates
add("agg_count", "SELECT ?m (COUNT(?b) AS ?n) (COUNT(DISTINCT ?k) AS ?d) WHERE { ?c :c_mktsegment ?m ; :c_acctbal ?b ; :c_nationkey ?k } GROUP BY ?m", "SELECT c_mktsegment AS m, count(c_acctbal) AS n, count(DISTINCT c_nationkey) AS d FROM customer GROUP BY 1")
add("agg_sum_avg", "SELECT ?f (SUM(?q) AS ?s) (ROUND(AVG(?p) * 100) / 100 AS ?a) WHERE { ?l :l_returnflag ?f ; :l_quantity ?q ; :l_extendedprice ?p } GROUP BY ?f", "SELECT l_returnflag AS f, sum(l_quantity) AS s, floor(avg(l_extendedprice) * 100 + 0.5) / 100 AS a FROM lineitem GROUP BY 1")
add("agg_avg_integer", "SELECT ?b (ROUND(xsd:double(AVG(?s)) * 1000000) / 1000000 AS ?a) WHERE { ?x :p_brand ?b ; :p_size ?s } GROUP BY ?b", "SELECT p_brand AS b, floor(avg(p_size) * 1000000 + 0.5) / 1000000 AS a FROM part GROUP BY 1")
add("agg_min_max", "SELECT ?m (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) (MIN(?n) AS ?first) WHERE { ?c :c_mktsegment ?m ; :c_acctbal ?b ; :c_name ?n } GROUP BY ?m", "SELECT c_mktsegment AS m, min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_name) AS first FROM customer GROUP BY 1")
add("agg_sample", "SELECT ?k (SAMPLE(?n) AS ?x) WHERE { ?c :n_nationkey ?k ; :n_name ?n } GROUP BY ?k", "SELECT n_nationkey AS k, n_name AS x FROM nation")
add("agg_group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?all) WHERE { ?x :n_regionkey/:r_name ?r ; :n_name ?n } GROUP BY ?r", "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS \"all\" FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("agg_group_concat_distinct", "SELECT (GROUP_CONCAT(DISTINCT ?m) AS ?all) WHERE { ?x :c_mktsegment ?m }", "SELECT string_agg(m, ' ' ORDER BY m) AS \"all\" FROM (SELECT DISTINCT c_mktsegment AS m FROM customer)")
add("agg_distinct", "SELECT ?f (SUM(DISTINCT ?k) AS ?s) WHERE { ?l :l_returnflag ?f ; :l_linenumber ?k } GROUP BY ?f", "SELECT l_returnflag AS f, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1")
add("count_star_distinct", "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { ?c :c_mktsegment ?m . ?c :c_nationkey ?k }", "SELECT count(*) AS n FROM customer")
add("having", "SELECT ?k (COUNT(*) AS ?n) WHERE { ?c :c_nationkey ?k } GROUP BY ?k HAVING(COUNT(*) > 55)", "SELECT 'urn:t:nation/' || c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 55")
add("agg_empty", "SELECT (COUNT(*) AS ?n) (SUM(?s) AS ?t) (AVG(?s) AS ?a) (GROUP_CONCAT(?b) AS ?g) (MIN(?s) AS ?m) WHERE { ?x :p_size ?s ; :p_brand ?b . FILTER(?s < 0) }", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS t, CAST(0 AS DECIMAL(38,16)) AS a, '' AS g, CAST(NULL AS INTEGER) AS m")
add("group_expr", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1")
# Paths
add("path_seq", "SELECT ?n ?r WHERE { ?c :c_name ?n ; :c_nationkey/:n_regionkey/:r_name ?r }", "SELECT c_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
add("path_alt", "SELECT ?x ?n WHERE { ?x (:s_name|:r_name) ?n }", "SELECT 'urn:t:supplier/' || s_suppkey AS x, s_name AS n FROM supplier UNION ALL SELECT 'urn:t:region/' || r_regionkey, r_name FROM region")
add("path_inv", "SELECT ?n ?x WHERE { ?r :r_name ?n ; ^:n_regionkey/:n_name ?x }", "SELECT r_name AS n, n_name AS x FROM region JOIN nation ON n_regionkey = r_regionkey")
add("path_plus", "SELECT ?n (COUNT(*) AS ?k) WHERE { ?s (:s_nationkey|:n_regionkey)+ ?r . ?r :r_name ?n } GROUP BY ?n", "SELECT r_name AS n, sum(c)::BIGINT AS k FROM (SELECT n_regionkey AS r, count(*) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_regionkey, count(*) FROM nation GROUP BY 1) JOIN region ON r = r_regionkey GROUP BY 1")
add("path_plus_symmetric", "SELECT (COUNT(*) AS ?k) WHERE { ?a (:n_regionkey/^:n_regionkey)+ ?b }", "SELECT count(*) AS k FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
add("path_plus_bound", "SELECT ?x WHERE { <urn:t:nation/2> (:n_regionkey/^:n_regionkey)+ ?x }", "SELECT 'urn:t:nation/' || b.n_nationkey AS x FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 2")
add("path_star", "SELECT ?x WHERE { <urn:t:supplier/1> (:s_nationkey|:n_regionkey)* ?x }", "SELECT 'urn:t:supplier/1' AS x UNION ALL SELECT 'urn:t:nation/' || s_nationkey FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT 'urn:t:region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1")
add("path_opt", "SELECT ?x WHERE { <urn:t:nation/2> :n_regionkey? ?x }", "SELECT 'urn:t:nation/2' AS x UNION ALL SELECT 'urn:t:region/' || n_regionkey FROM nation WHERE n_nationkey = 2")
add("path_neg", "SELECT ?s ?o WHERE { GRAPH g:region { ?s !(:r_regionkey|rdf:type) ?o } }", "SELECT 'urn:t:region/' || r_regionkey AS s, r_name AS o FROM region")
# Graphs and forms
add("graph_const", "SELECT ?n WHERE { GRAPH g:nation { ?x :n_name ?n } }", "SELECT n_name AS n FROM nation")
add("graph_const_other", "SELECT ?n WHERE { GRAPH g:region { ?x :n_name ?n } }", "SELECT n_name AS n FROM nation WHERE false")
add("graph_var", "SELECT ?g ?n WHERE { GRAPH ?g { ?x :n_name ?n } }", "SELECT 'urn:g:nation' AS g, n_name AS n FROM nation")
add("from", "SELECT ?n FROM g:region WHERE { { ?x :n_name ?n } UNION { ?y :r_name ?n } }", "SELECT r_name AS n FROM region")
add("from_named", "SELECT ?g ?n FROM g:customer FROM NAMED g:region WHERE { GRAPH ?g { { ?x :n_name ?n } UNION { ?y :r_name ?n } } }", "SELECT 'urn:g:region' AS g, r_name AS n FROM region")
add("ask", "ASK { ?c :c_acctbal ?b FILTER(?b > 9999) }", "SELECT count(*) > 0 AS ask FROM customer WHERE c_acctbal > 9999")
add("ask_no", "ASK { ?c :c_acctbal ?b FILTER(?b > 99999) }", "SELECT false AS ask")
add("construct", "CONSTRUCT { ?n :in ?r . ?r :has ?n } WHERE { ?n :n_regionkey ?r }", "SELECT 'urn:t:nation/' || n_nationkey AS subject, 'urn:t:in' AS predicate, 'urn:t:region/' || n_regionkey AS object FROM nation UNION SELECT 'urn:t:region/' || n_regionkey, 'urn:t:has', 'urn:t:nation/' || n_nationkey FROM nation")
add("describe_type", "DESCRIBE ?n WHERE { ?n :n_regionkey <urn:t:region/1> }", "SELECT 'urn:t:nation/' || n_nationkey AS subject, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS predicate, 'urn:t:nation' AS object FROM nation WHERE n_regionkey = 1")


# Functions: one expression over one variable of a table, and its SQL
def fn(name: str, pattern: str, expression: str, table: str, sql: str, key: str = "?n", key_sql: str | None = None) -> None:
    column = key_sql or {"part": "p_name", "customer": "c_name", "nation": "n_name", "orders": "o_orderkey", "documents": "doc_id", "region": "r_name", "lineitem": "l_extendedprice", "events": "event_id"}[table]
    add(name, f"SELECT {key} ({expression} AS ?v) WHERE {{ {pattern} }}", f"SELECT {column} AS n, {sql} AS v FROM {table}")


_PART, _DOC, _ORDER = "?x :p_name ?n ; :p_brand ?b ; :p_type ?t ; :p_size ?s ; :p_retailprice ?p", "?x :documents_doc_id ?n ; :documents_text ?t ; :documents_source ?s", "?x :o_orderkey ?n ; :o_orderdate ?d ; :o_totalprice ?p ; :o_orderstatus ?s"
for _n, _e, _s in [
    ("fn_strlen", "STRLEN(?t)", "CAST(length(p_type) AS BIGINT)"), ("fn_substr", "SUBSTR(?t, 2, 4)", "substr(p_type, 2, 4)"), ("fn_substr_tail", "SUBSTR(?t, 3)", "substr(p_type, 3)"),
    ("fn_ucase", "UCASE(?n)", "upper(p_name)"), ("fn_lcase", "LCASE(?b)", "lower(p_brand)"), ("fn_strstarts", "STRSTARTS(?t, 'S')", "starts_with(p_type, 'S')"),
    ("fn_strends", "STRENDS(?b, '1')", "ends_with(p_brand, '1')"), ("fn_contains", "CONTAINS(?t, 'A')", "contains(p_type, 'A')"),
    ("fn_strbefore", "STRBEFORE(?b, '#')", "CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 1) ELSE '' END"), ("fn_strafter", "STRAFTER(?b, '#')", "CASE WHEN contains(p_brand, '#') THEN substr(p_brand, strpos(p_brand, '#') + 1) ELSE '' END"),
    ("fn_encode_for_uri", "ENCODE_FOR_URI(CONCAT(?b, ' *~é'))", "replace(p_brand, '#', '%23') || '%20%2A~%C3%A9'"), ("fn_concat", "CONCAT(?b, '/', ?t)", "p_brand || '/' || p_type"),
    ("fn_regex", "REGEX(?t, '^[a-m]', 'i')", "regexp_matches(p_type, '^[a-mA-M]')"), ("fn_regex_flags", "REGEX(?t, 'a.*e', 'is')", "regexp_matches(lower(p_type), 'a.*e')"),
    ("fn_replace", "REPLACE(?b, '([0-9])', '<$1>')", "regexp_replace(p_brand, '([0-9])', '<\\1>', 'g')"), ("fn_md5", "MD5(?n)", "md5(p_name)"), ("fn_sha256", "SHA256(?n)", "sha256(p_name)"), ("fn_sha1", "SHA1(?n)", "sha1(p_name)"),
    ("fn_abs", "ABS(?s - 25)", "CAST(abs(p_size - 25) AS BIGINT)"), ("fn_round", "ROUND(?p)", "floor(p_retailprice + 0.5)"), ("fn_ceil", "CEIL(?p)", "ceil(p_retailprice)"), ("fn_floor", "FLOOR(?p)", "floor(p_retailprice)"),
    ("fn_if", "IF(?s > 25, 'big', 'small')", "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END"), ("fn_coalesce", "COALESCE(?nothing, ?b + 1, ?t)", "p_type"), ("fn_in", "?s IN (1, 2, 3)", "p_size IN (1, 2, 3)"),
    ("fn_str", "STR(?s)", "CAST(p_size AS VARCHAR)"), ("fn_datatype", "DATATYPE(?s)", "'http://www.w3.org/2001/XMLSchema#integer'"), ("fn_is_iri", "ISIRI(?x)", "true"), ("fn_is_literal", "ISLITERAL(?x)", "false"), ("fn_is_blank", "ISBLANK(?x)", "false"),
    ("fn_is_numeric", "ISNUMERIC(?s) && !ISNUMERIC(?b)", "true"), ("fn_iri", "IRI(CONCAT('urn:b:', ?b))", "'urn:b:' || p_brand"), ("fn_strdt", "STRDT(?b, :brand)", "p_brand"), ("fn_strlang", "LANG(STRLANG(?b, 'EN-gb'))", "'en-gb'"),
    ("fn_sameterm", "SAMETERM(?s, 5)", "p_size = 5"), ("fn_bound", "BOUND(?b) && !BOUND(?nope)", "true"), ("fn_unary_minus", "-?s", "CAST(-p_size AS BIGINT)"),
    ("cast_integer", "xsd:integer(?p)", "CAST(trunc(p_retailprice) AS BIGINT)"), ("cast_int", "xsd:int(STR(?s))", "p_size"), ("cast_double", "xsd:double(?s)", "CAST(p_size AS DOUBLE)"), ("cast_float", "xsd:float(?s)", "CAST(p_size AS FLOAT)"),
    ("cast_decimal", "xsd:decimal(?s)", "CAST(p_size AS DECIMAL(38,16))"), ("cast_string", "xsd:string(?s)", "CAST(p_size AS VARCHAR)"), ("cast_boolean", "xsd:boolean(?s - 1)", "p_size <> 1"), ("cast_error", "xsd:integer(?b)", "CAST(NULL AS BIGINT)"),
]:
    fn(_n, _PART, _e, "part", _s)
for _n, _e, _s in [
    ("fn_lang", "LANG(?t)", "lang"), ("fn_langmatches", "LANGMATCHES(LANG(?t), 'EN')", "lang = 'en'"), ("fn_langmatches_any", "LANGMATCHES(LANG(?t), '*')", "lang <> ''"), ("fn_strlen_tagged", "STRLEN(?t)", "CAST(length(text) AS BIGINT)"),
    ("fn_datatype_tagged", "DATATYPE(?t)", "'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString'"), ("fn_sha384", "SHA384(STR(?s))", None), ("fn_sha512", "SHA512(?s)", None),
]:
    fn(_n, _DOC, _e, "documents", _s or "NULL")
    if _s is None:
        CATALOG[_n] = (CATALOG[_n][0], None)
for _n, _e, _s in [
    ("fn_year", "YEAR(?d)", "CAST(year(o_orderdate) AS BIGINT)"), ("fn_month", "MONTH(?d)", "CAST(month(o_orderdate) AS BIGINT)"), ("fn_day", "DAY(?d)", "CAST(day(o_orderdate) AS BIGINT)"), ("fn_hours", "HOURS(?d)", "CAST(hour(o_orderdate) AS BIGINT)"),
    ("fn_minutes", "MINUTES(?d)", "CAST(minute(o_orderdate) AS BIGINT)"), ("fn_tz", "TZ(?d)", "''"), ("fn_timezone", "TIMEZONE(?d)", "CAST(NULL AS VARCHAR)"), ("cast_datetime", "xsd:dateTime('2001-02-03T04:05:06')", "'2001-02-03T04:05:06'"),
]:
    fn(_n, _ORDER, _e, "orders", _s)
add("fn_seconds", "SELECT ?n (xsd:double(SECONDS(?d)) AS ?v) WHERE { ?x :events_event_id ?n ; :events_ts ?d }", "SELECT event_id AS n, CAST(date_part('microseconds', ts) AS DOUBLE) / 1000000 AS v FROM events")
add("fn_random", "SELECT (RAND() AS ?r) (UUID() AS ?u) (STRUUID() AS ?s) (BNODE() AS ?b) (NOW() AS ?t) WHERE { ?x :r_name ?n }", None)
# Shapes of the benchmarks: e-commerce exploration and business intelligence, time series
add("bsbm_like_q1", "SELECT DISTINCT ?x ?n WHERE { ?x :p_name ?n ; :p_type ?t ; :p_brand 'Brand#12' ; :p_size ?s . FILTER(?s > 20) } ORDER BY ?n ?x LIMIT 10", "SELECT DISTINCT 'urn:t:part/' || p_partkey AS x, p_name AS n FROM part WHERE p_brand = 'Brand#12' AND p_size > 20 ORDER BY n, x LIMIT 10")
add("bsbm_like_q2", "SELECT ?n ?b ?t ?q WHERE { <urn:t:part/20> :p_name ?n ; :p_brand ?b ; :p_type ?t . OPTIONAL { ?l :l_partkey <urn:t:part/20> ; :l_quantity ?q . FILTER(?q > 45) } }", "SELECT p_name AS n, p_brand AS b, p_type AS t, l_quantity AS q FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 WHERE p_partkey = 20")
add("bsbm_like_q3", "SELECT ?x ?n WHERE { ?x :p_name ?n ; :p_size ?s . FILTER(?s > 45) OPTIONAL { ?l :l_partkey ?x ; :l_quantity 50.0e0 . BIND(1 AS ?hit) } FILTER(!BOUND(?hit)) } ORDER BY ?n ?x LIMIT 10", "SELECT 'urn:t:part/' || p_partkey AS x, p_name AS n FROM part WHERE p_size > 45 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) ORDER BY n, x LIMIT 10")
add("bsbm_like_q4", "SELECT DISTINCT ?x ?n WHERE { { ?x :p_name ?n ; :p_size ?s . FILTER(?s > 48) } UNION { ?x :p_name ?n ; :p_retailprice ?p . FILTER(?p > 1900) } } ORDER BY ?n ?x OFFSET 5 LIMIT 10", "SELECT DISTINCT 'urn:t:part/' || p_partkey AS x, p_name AS n FROM part WHERE p_size > 48 OR p_retailprice > 1900 ORDER BY n, x LIMIT 10 OFFSET 5")
add("bsbm_like_q5", "SELECT DISTINCT ?x ?n WHERE { ?x :p_name ?n ; :p_size ?s ; :p_retailprice ?p . <urn:t:part/9> :p_size ?s0 ; :p_retailprice ?p0 . FILTER(?x != <urn:t:part/9> && ?s < ?s0 + 12 && ?s > ?s0 - 12 && ?p < ?p0 + 170 && ?p > ?p0 - 170) } ORDER BY ?n ?x LIMIT 5", "SELECT DISTINCT 'urn:t:part/' || b.p_partkey AS x, b.p_name AS n FROM part a JOIN part b ON b.p_partkey <> 9 AND b.p_size < a.p_size + 12 AND b.p_size > a.p_size - 12 AND b.p_retailprice < a.p_retailprice + 170 AND b.p_retailprice > a.p_retailprice - 170 WHERE a.p_partkey = 9 ORDER BY n, x LIMIT 5")
add("bsbm_like_q7", "SELECT ?n ?q ?s ?o WHERE { <urn:t:part/33> :p_name ?n . OPTIONAL { ?l :l_partkey <urn:t:part/33> ; :l_quantity ?q ; :l_suppkey ?k . ?k :s_name ?s . OPTIONAL { ?l :l_orderkey/:o_orderstatus ?o } } }", "SELECT p_name AS n, l_quantity AS q, s_name AS s, o_orderstatus AS o FROM part LEFT JOIN (lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey) ON l_partkey = p_partkey WHERE p_partkey = 33")
add("bsbm_like_q8", "SELECT ?d ?l ?q WHERE { ?d :documents_text ?t ; :documents_lang ?l . FILTER(LANGMATCHES(LANG(?t), 'EN')) OPTIONAL { ?d :labels_quality ?q } } ORDER BY ?d LIMIT 20", "SELECT 'urn:t:documents/' || d.doc_id AS d, lang AS l, quality AS q FROM documents d LEFT JOIN labels x ON d.doc_id = x.doc_id WHERE lang = 'en' ORDER BY 1 LIMIT 20")
add("bsbm_like_q9", "CONSTRUCT { ?c :named ?n } WHERE { <urn:t:orders/5> :o_custkey ?c . ?c :c_name ?n }", "SELECT 'urn:t:customer/' || c_custkey AS subject, 'urn:t:named' AS predicate, c_name AS object FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 5")
add("bsbm_like_q10", "SELECT DISTINCT ?l ?p WHERE { ?o :l_partkey <urn:t:part/12> ; :l_extendedprice ?p ; :l_suppkey ?s ; :l_shipdate ?d ; :l_linenumber ?l . ?s :s_nationkey ?k . FILTER(?d > '1993-01-01T00:00:00'^^xsd:dateTime) } ORDER BY ?p LIMIT 10", "SELECT DISTINCT l_linenumber AS l, l_extendedprice AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = 12 AND l_shipdate > TIMESTAMP '1993-01-01' ORDER BY p LIMIT 10")
add("bsbm_like_q11", "SELECT ?p ?v WHERE { { <urn:t:customer/9> ?p ?v } UNION { ?v ?p <urn:t:customer/9> } }", "SELECT unnest(['urn:t:c_custkey','urn:t:c_name','urn:t:c_nationkey','urn:t:c_acctbal','urn:t:c_mktsegment','http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p, unnest([CAST(c_custkey AS VARCHAR), c_name, 'urn:t:nation/' || c_nationkey, CAST(c_acctbal AS VARCHAR), c_mktsegment, 'urn:t:customer']) AS v FROM customer WHERE c_custkey = 9 UNION ALL SELECT 'urn:t:o_custkey', 'urn:t:orders/' || o_orderkey FROM orders WHERE o_custkey = 9")
add("bsbm_like_q12", "CONSTRUCT { ?o :total ?p ; :of ?n } WHERE { VALUES ?o { <urn:t:orders/3> } ?o :o_totalprice ?p ; :o_custkey/:c_name ?n }", "SELECT 'urn:t:orders/3' AS subject, 'urn:t:of' AS predicate, c_name AS object FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 3 UNION ALL SELECT 'urn:t:orders/3', 'urn:t:total', CAST(o_totalprice AS VARCHAR) FROM orders WHERE o_orderkey = 3")
add("bi_like_q1", "SELECT ?t (COUNT(*) AS ?n) WHERE { ?l :l_partkey/:p_type ?t ; :l_suppkey/:s_nationkey <urn:t:nation/3> ; :l_orderkey/:o_custkey/:c_nationkey <urn:t:nation/5> } GROUP BY ?t ORDER BY DESC(?n) ?t LIMIT 10", "SELECT p_type AS t, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey = 3 AND c_nationkey = 5 GROUP BY 1 ORDER BY n DESC, t LIMIT 10")
add("bi_like_q2", "SELECT ?y (COUNT(?k) AS ?n) WHERE { ?l :l_partkey <urn:t:part/7> ; :l_orderkey ?o . ?o :o_custkey ?c . ?m :o_custkey ?c . ?z :l_orderkey ?m ; :l_partkey ?y ; :l_linenumber ?k . FILTER(?y != <urn:t:part/7>) } GROUP BY ?y ORDER BY DESC(?n) ?y LIMIT 10", "SELECT 'urn:t:part/' || z.l_partkey AS y, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN orders m ON m.o_custkey = o.o_custkey JOIN lineitem z ON z.l_orderkey = m.o_orderkey WHERE l.l_partkey = 7 AND z.l_partkey <> 7 GROUP BY 1 ORDER BY n DESC, y LIMIT 10")
add("bi_like_q3", "SELECT ?m ?a ?b WHERE { { SELECT ?m (COUNT(?p) AS ?a) WHERE { ?o :o_custkey/:c_mktsegment ?m ; :o_orderdate ?d ; :o_totalprice ?p . FILTER(YEAR(?d) = 1995) } GROUP BY ?m } { SELECT ?m (COUNT(?p) AS ?b) WHERE { ?o :o_custkey/:c_mktsegment ?m ; :o_orderdate ?d ; :o_totalprice ?p . FILTER(YEAR(?d) = 1996) } GROUP BY ?m } FILTER(?a > 0) }", "SELECT c_mktsegment AS m, count(*) FILTER (year(o_orderdate) = 1995) AS a, count(*) FILTER (year(o_orderdate) = 1996) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
add("bi_like_q4", "SELECT ?b ?hi ?n WHERE { { SELECT ?b (MAX(?p) AS ?hi) (COUNT(*) AS ?n) WHERE { ?x :p_brand ?b . ?l :l_partkey ?x ; :l_extendedprice ?p } GROUP BY ?b } FILTER(?n > 100) }", "SELECT p_brand AS b, max(l_extendedprice) AS hi, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) > 100")
add("bi_like_q5", "SELECT ?k ?b ?n WHERE { { SELECT ?k (MAX(?c) AS ?n) WHERE { { SELECT ?k ?b (COUNT(*) AS ?c) WHERE { ?l :l_partkey/:p_brand ?b ; :l_suppkey/:s_nationkey ?k } GROUP BY ?k ?b } } GROUP BY ?k } { SELECT ?k ?b (COUNT(*) AS ?n) WHERE { ?l :l_partkey/:p_brand ?b ; :l_suppkey/:s_nationkey ?k } GROUP BY ?k ?b } }", "WITH x AS (SELECT s_nationkey AS k, p_brand AS b, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT 'urn:t:nation/' || k AS k, b, n FROM x WHERE n = (SELECT max(n) FROM x y WHERE y.k = x.k)")
add("bi_like_q6", "SELECT ?n (COUNT(?p) AS ?c) WHERE { ?s :s_name ?n . ?l :l_suppkey ?s ; :l_extendedprice ?p . { SELECT (AVG(?q) AS ?a) WHERE { ?z :l_extendedprice ?q } } FILTER(?p > ?a * 1.5) } GROUP BY ?n", "SELECT s_name AS n, count(*) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_extendedprice > (SELECT avg(l_extendedprice) FROM lineitem) * 1.5 GROUP BY 1")
add("bi_like_q7", "SELECT DISTINCT ?x WHERE { ?x :p_size 7 . FILTER NOT EXISTS { ?l :l_partkey ?x ; :l_suppkey/:s_nationkey <urn:t:nation/1> } }", "SELECT 'urn:t:part/' || p_partkey AS x FROM part WHERE p_size = 7 AND NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_nationkey = 1)")
add("bi_like_q8", "SELECT ?s (xsd:double(?below) / ?n AS ?r) WHERE { { SELECT ?s (COUNT(*) AS ?n) (SUM(?lo) AS ?below) WHERE { ?l :l_suppkey ?s ; :l_discount ?d . BIND(IF(?d < 0.05e0, 1, 0) AS ?lo) } GROUP BY ?s } }", "SELECT 'urn:t:supplier/' || l_suppkey AS s, CAST(sum(CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS r FROM lineitem GROUP BY l_suppkey")
add("wind_like_1", "SELECT ?e ?v WHERE { ?x :events_event_type ?e ; :events_value ?v ; :events_user_id 17 }", "SELECT event_type AS e, value AS v FROM events WHERE user_id = 17")
add("wind_like_2", "SELECT ?e (COUNT(?v) AS ?n) (MIN(?v) AS ?lo) (MAX(?v) AS ?hi) WHERE { ?x :events_event_type ?e ; :events_value ?v ; :events_ts ?t . FILTER(HOURS(?t) < 6) } GROUP BY ?e", "SELECT event_type AS e, count(value) AS n, min(value) AS lo, max(value) AS hi FROM events WHERE hour(ts) < 6 GROUP BY 1")
add("wind_like_3", "SELECT ?e ?y ?mo ?d ?h ?b (ROUND(AVG(?v) * 1000) / 1000 AS ?a) WHERE { ?x :events_event_type ?e ; :events_value ?v ; :events_ts ?t . BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?mo) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) BIND(xsd:integer(FLOOR(MINUTES(?t) / 10)) AS ?b) } GROUP BY ?e ?y ?mo ?d ?h ?b", "SELECT event_type AS e, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS mo, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) // 10 AS BIGINT) AS b, floor(avg(value) * 1000 + 0.5) / 1000 AS a FROM events GROUP BY ALL")
add("wind_like_4", "SELECT ?u (COUNT(DISTINCT ?e) AS ?k) WHERE { ?x :events_user_id ?u ; :events_event_type ?e } GROUP BY ?u HAVING(COUNT(DISTINCT ?e) > 3)", "SELECT user_id AS u, count(DISTINCT event_type) AS k FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 3")


# Over the tables as quads: the store's path. Names, SPARQL, SQL as above; all results are text.
QUADS: dict[str, tuple[str, str | None]] = {}
QUAD_TABLES = ("region", "nation", "customer", "supplier", "orders")


def add_quads(name: str, sparql: str, sql: str) -> None:
    QUADS[name] = (sparql, sql)


add_quads("quads_star", "SELECT ?n ?m WHERE { ?c :c_name ?n ; :c_mktsegment ?m ; a :customer }", "SELECT c_name AS n, c_mktsegment AS m FROM customer")
add_quads("quads_constant", "SELECT ?p ?o WHERE { <urn:t:nation/4> ?p ?o }", "SELECT unnest(['urn:t:n_nationkey','urn:t:n_name','urn:t:n_regionkey','http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p, unnest([CAST(n_nationkey AS VARCHAR), n_name, 'urn:t:region/' || n_regionkey, 'urn:t:nation']) AS o FROM nation WHERE n_nationkey = 4")
add_quads("quads_join", "SELECT ?r (COUNT(*) AS ?n) WHERE { ?o :o_custkey ?c . ?c :c_nationkey ?k . ?k :n_regionkey/:r_name ?r } GROUP BY ?r", "SELECT r_name AS r, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add_quads("quads_filter", "SELECT ?c WHERE { ?c :c_acctbal ?b . FILTER(?b > 9000 && ?b <= 9500) }", "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_acctbal > 9000 AND c_acctbal <= 9500")
add_quads("quads_bind", "SELECT ?k ?d WHERE { ?n :n_nationkey ?k . BIND(?k * 2 + 1 AS ?d) FILTER(?d > 20) }", "SELECT CAST(n_nationkey AS VARCHAR) AS k, CAST(n_nationkey * 2 + 1 AS VARCHAR) AS d FROM nation WHERE n_nationkey * 2 + 1 > 20")
add_quads("quads_optional", "SELECT ?n ?x WHERE { ?k :n_name ?n . OPTIONAL { ?s :s_nationkey ?k ; :s_name ?x ; :s_acctbal ?b . FILTER(?b > 8000) } }", "SELECT n_name AS n, s_name AS x FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000")
add_quads("quads_union", "SELECT ?n WHERE { { ?c :c_name ?n } UNION { ?s :s_name ?n } }", "SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier")
add_quads("quads_minus", "SELECT ?n WHERE { ?k :n_name ?n MINUS { ?s :s_nationkey ?k } }", "SELECT n_name AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
add_quads("quads_exists", "SELECT ?n WHERE { ?c :c_name ?n ; :c_acctbal ?b . FILTER EXISTS { ?o :o_custkey ?c ; :o_totalprice ?p . BIND(?b * 40 AS ?f) FILTER(?p > ?f && ?f > 0) } }", "SELECT c_name AS n FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)")
add_quads("quads_path_plus", "SELECT ?x WHERE { <urn:t:customer/7> (:c_nationkey|:n_regionkey)+ ?x }", "SELECT 'urn:t:nation/' || c_nationkey AS x FROM customer WHERE c_custkey = 7 UNION SELECT 'urn:t:region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
add_quads("quads_group", "SELECT ?m (COUNT(DISTINCT ?k) AS ?n) (MIN(?x) AS ?lo) WHERE { ?c :c_mktsegment ?m ; :c_nationkey ?k ; :c_custkey ?x } GROUP BY ?m HAVING(COUNT(*) > 1)", "SELECT c_mktsegment AS m, count(DISTINCT c_nationkey) AS n, CAST(min(c_custkey) AS VARCHAR) AS lo FROM customer GROUP BY 1 HAVING count(*) > 1")
add_quads("quads_order", "SELECT ?x WHERE { ?c :c_custkey ?x } ORDER BY DESC(?x) LIMIT 7", "SELECT CAST(c_custkey AS VARCHAR) AS x FROM customer ORDER BY c_custkey DESC LIMIT 7")
add_quads("quads_term_order", "SELECT ?v WHERE { { SELECT ?v WHERE { VALUES ?v { 'b' <urn:x> 7 UNDEF } } ORDER BY ?v LIMIT 2 } }", "SELECT NULL AS v UNION ALL SELECT 'urn:x'")
add_quads("quads_blank_node", "SELECT ?n WHERE { [] :n_regionkey <urn:t:region/1> ; :n_name ?n }", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1")
add_quads("quads_describe", "DESCRIBE <urn:t:region/2>", "SELECT 'urn:t:region/2' AS subject, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS predicate, 'urn:t:region' AS object")
add_quads("store_load", "SELECT ?p (COUNT(*) AS ?n) (COUNT(DISTINCT ?o) AS ?d) WHERE { ?s ?p ?o } GROUP BY ?p", "SELECT unnest(['urn:t:r_regionkey','urn:t:r_name','http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p, count(*) AS n, unnest([count(DISTINCT r_regionkey), count(DISTINCT r_name), 1]) AS d FROM region")
add_quads("store_changes", "SELECT ?s ?o WHERE { ?s :r_name ?o }", "SELECT 'urn:t:region/' || r_regionkey AS s, r_name AS o FROM region WHERE r_regionkey <> 0 UNION ALL SELECT 'urn:t:region/' || n, 'new ' || n FROM range(100, 106) t(n) WHERE n <> 105")


def quads_of(spark: SparkSession, folder: str, tables: tuple[str, ...] = QUAD_TABLES) -> DataFrame:
    whole = warehouse(spark, folder)
    return MappedSource(spark, [whole.tables[t] for t in tables]).quads()


def _written(spark: SparkSession, folder: str) -> Store:
    """A store of QUAD_TABLES, written once for each session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORES:
        path = f"{shared_root(spark)}/graphloom/quads-{uuid.uuid4().hex}"
        Store(spark, quads_of(spark, folder), unique=True).write_parquet(path, gather=False)
        _STORES[key] = path
    return Store.read_parquet(spark, _STORES[key])


def _store(spark: SparkSession, folder: str, name: str) -> Engine:
    """The region table written as lines, loaded into a store and, for store_changes, changed quad by quad."""
    path = f"{shared_root(spark)}/graphloom/store-{uuid.uuid4().hex}"
    Store(spark, quads_of(spark, folder, ("region",))).write_lines(path)
    store = Store(spark)
    store.load_path(path, "nq")
    if name == "store_changes":
        node = lambda k: IRI(f"urn:t:region/{k}")
        for k in range(100, 106):
            store.insert((None, node(k), IRI("urn:t:r_name"), Literal(f"new {k}")))
        first = store.matching(node(0), IRI("urn:t:r_name")).first()
        for quad in ((None, node(0), IRI("urn:t:r_name"), term_of(first["object"])), (None, node(105), IRI("urn:t:r_name"), Literal("new 105"))):
            store.remove(quad)
    return store.engine


_ENGINES: dict[tuple[str, str], Engine] = {}
_STORES: dict[tuple[str, str], str] = {}


def engine(spark: SparkSession, folder: str) -> Engine:
    """One engine for each session and folder, so that tables' schemas and file lists are read once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _ENGINES:
        _ENGINES[key] = Engine(spark, warehouse(spark, folder), prefixes=PREFIXES)
    return _ENGINES[key]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(text: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: engine(spark, folder).query(text, native=True)

    def over_quads(name: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
        def go(spark: SparkSession, folder: str) -> DataFrame:
            e = _store(spark, folder, name) if name.startswith("store_") else _written(spark, folder).engine
            e.prefixes = PREFIXES
            return e.query(text, native=True)

        return go

    return {name: run(text) for name, (text, _) in CATALOG.items()} | {name: over_quads(name, text) for name, (text, _) in QUADS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (CATALOG | QUADS).items() if sql is not None}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder).query(
        "SELECT ?name ?price WHERE { ?o a :orders ; :o_totalprice ?price ; :o_custkey ?c . ?c :c_name ?name . FILTER(?price > 400000) } ORDER BY DESC(?price) LIMIT 20", native=True
    )
