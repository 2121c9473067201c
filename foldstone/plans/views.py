"""Deterministic stand-ins, derived from the driver's tables, for rasters, lines, events and results.

Each is one statement that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldstone.session import table

#: The statements of the fixture views.
VIEWS = {
    "v_dem": (("part",), "select cast(floor(p_partkey/20e0) as bigint) r, p_partkey%20 c, p_size*10e0+p_retailprice v from part"),
    "v_cover": (("part",), "select cast(floor(p_partkey/20e0) as bigint) r, p_partkey%20 c, case p_size%12 when 0 then 0 when 9 then 90 when 10 then 95 when 11 then 100 else (p_size%12)*10 end code from part"),
    "v_cells": (("part",), "select p_partkey id, cast(floor(p_partkey/20e0) as bigint) r, p_partkey%20 c, p_type<>'STANDARD' valid, greatest(p_size-10,0)*1e0 w from part"),
    "v_pts": (
        ("customer",),
        """select c_custkey id, 80e0+((c_custkey*37)%840)/100e0 lon, 26.2e0+((c_custkey*53)%440)/100e0 lat,
 ((c_custkey*7919)%400000)*1e0 x, ((c_custkey*104729)%200000)*1e0 y,
 case when c_mktsegment='AUTOMOBILE' then 1 else 0 end label,
 case when c_mktsegment='AUTOMOBILE' then 'presence' when c_mktsegment in ('BUILDING','FURNITURE') then 'uniform' else 'road_weighted' end abs_set,
 case when c_mktsegment<>'AUTOMOBILE' then null when c_nationkey%6=0 then 0e0 when c_nationkey%6=1 then 1e0 when c_nationkey%6=2 then 5e0 when c_nationkey%6=3 then 10e0 when c_nationkey%6=4 then 25e0 else 50e0 end accuracy_km,
 c_acctbal f1 from customer""",
    ),
    "v_zpts": (("supplier",), "select s_suppkey id, ((s_suppkey*17)%97)+0.25e0 prow, ((s_suppkey*13)%19)+0.5e0 pcol from supplier"),
    "v_seg": (
        ("supplier",),
        """select s_suppkey way_id, case s_nationkey%4 when 0 then 'primary' when 1 then 'residential' when 2 then 'track' else 'river' end kind,
 ((s_suppkey*48271)%400000)*1e0 x0, ((s_suppkey*16807)%200000)*1e0 y0,
 ((s_suppkey*48271)%400000)+((s_suppkey*7)%5-2)*3000e0 x1, ((s_suppkey*16807)%200000)+((s_suppkey*11)%7-3)*2000e0 y1 from supplier""",
    ),
    "v_stack": (("orders",), "select cast(year(o_orderdate) as bigint) yr, cast(floor(o_custkey/20e0) as bigint) r, o_custkey%20 c, case when o_orderstatus='P' then null else o_totalprice end v from orders"),
    "v_catalogue": (
        ("orders", "customer", "nation", "region"),
        """select o_orderkey event_id, case when o_orderkey%3=0 then concat('  ',lower(r_name),' ') else r_name end country_name,
 case o_orderpriority when '1-URGENT' then 'exact' when '2-HIGH' then '1km' when '3-MEDIUM' then '5km' when '5-LOW' then '25km' else 'unknown' end location_accuracy,
 case o_orderkey%3 when 0 then 'not a date' when 1 then cast(1000*(800000000+o_orderkey*3600) as varchar(20)) else concat(substr(cast(o_orderdate as varchar(30)),1,10),'') end event_date,
 o_custkey from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey""",
    ),
    "v_scored": (("documents", "labels"), "select d.doc_id id, quality y, (n_chars%200)/200e0 score, d.doc_id%5 rfold, cast(floor((d.doc_id%50)/10e0) as bigint) sfold from documents d join labels l on d.doc_id=l.doc_id"),
    "v_ring": (
        (),
        "select * from (values (0,50000e0,20000e0,350000e0,20000e0),(1,350000e0,20000e0,350000e0,180000e0),(2,350000e0,180000e0,200000e0,90000e0),(3,200000e0,90000e0,50000e0,180000e0),(4,50000e0,180000e0,50000e0,20000e0)) t(i,x0,y0,x1,y1)",
    ),
    "v_runs": (
        ("lineitem",),
        "select l_returnflag abs_set, cast(l_linenumber as bigint) draw, concat('m',cast(cast(l_quantity as bigint)%5 as varchar(5))) model, round(avg(l_discount)*10e0,6) spatial_auroc, round(avg(l_tax)*10e0,6) random_auroc, count(*) n_abs from lineitem group by 1,2,3",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, statement = VIEWS[name]
    return spark.sql(statement_over(statement, tables), **{t: table(spark, sf_dir, t) for t in tables}) if tables else spark.sql(statement)


def statement_over(statement: str, tables: tuple[str, ...]) -> str:
    """The statement with each table in FROM or JOIN as a parameter."""
    import re

    for t in tables:
        statement = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", statement)
    return statement


def with_views(body: str, *names: str) -> str:
    """SQL for DuckDB: the views as common table expressions before ``body``, which may begin with more of them."""
    ctes = ", ".join(f"{n} as ({VIEWS[n][1]})" for n in names)
    if body.lstrip().lower().startswith("with "):
        return f"with {ctes}, {body.lstrip()[5:]}"
    return f"with {ctes} {body}"
