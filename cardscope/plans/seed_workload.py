"""Statements over the test tables, with their exact counts left to the queries; used by tests, benchmarks and queries."""

# The seed statements.
STATEMENTS = {
    "orders_status_price": "SELECT COUNT(*) FROM orders WHERE o_orderstatus='F' AND o_totalprice BETWEEN 100000 AND 200000;",
    "orders_priority": "SELECT COUNT(*) FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH') AND o_totalprice > 300000;",
    "lineitem_flags": "SELECT COUNT(*) FROM lineitem WHERE l_returnflag='R' AND l_quantity < 10 AND l_discount >= 0.05;",
    "part_impossible": "SELECT COUNT(*) FROM part WHERE p_size <= 10 AND p_retailprice >= 1500;",
    "customer_segment": "SELECT COUNT(*) FROM customer WHERE c_mktsegment='BUILDING' AND c_acctbal < 0;",
    "events_clicks": "SELECT COUNT(*) FROM events WHERE event_type='click' AND value > 50;",
    "customer_orders": "SELECT COUNT(*) FROM customer c, orders o WHERE c.c_custkey=o.o_custkey AND c.c_mktsegment='BUILDING' AND o.o_orderstatus='F';",
    "customer_orders_lineitem": "SELECT COUNT(*) FROM customer c, orders o, lineitem l WHERE c.c_custkey=o.o_custkey AND o.o_orderkey=l.l_orderkey AND o.o_totalprice>300000 AND l.l_quantity<10;",
    "lineitem_part_supplier": "SELECT COUNT(*) FROM lineitem l, part p, supplier s WHERE l.l_partkey=p.p_partkey AND l.l_suppkey=s.s_suppkey AND p.p_size<=10 AND s.s_acctbal>0;",
    "region_to_lineitem": "SELECT COUNT(*) FROM region r, nation n, customer c, orders o, lineitem l WHERE r.r_regionkey=n.n_regionkey AND n.n_nationkey=c.c_nationkey AND c.c_custkey=o.o_custkey AND o.o_orderkey=l.l_orderkey AND r.r_name='ASIA' AND l.l_returnflag='R';",
}
