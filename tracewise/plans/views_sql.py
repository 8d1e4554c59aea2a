"""The adapter views of ``tracewise.sources.testdata`` as SQL text.

Used to build the DuckDB oracle queries (and runnable on Spark SQL too). Each
view lists the views it reads; ``with_views`` prefixes a query with the CTEs
it needs, in dependency order.
"""

from __future__ import annotations

import re

ASSEMBLY = "(case when o_orderstatus = 'P' then 'K' else 'C' end) || cast(o_orderkey as varchar)"

VIEWS: dict[str, str] = {
    "products": """
        select 'P' || cast(o_orderkey as varchar) as ProductID,
               'Model ' || o_orderpriority as ModelName
        from orders""",
    "product_root": f"""
        select 'P' || cast(o_orderkey as varchar) as ProductID, {ASSEMBLY} as ComponentID
        from orders""",
    "components": f"""
        select {ASSEMBLY} as ComponentID, 'Assembly ' || cast(o_orderkey as varchar) as ComponentName
        from orders
        union all
        select 'X' || cast(p_partkey as varchar), p_name from part""",
    "raw_materials": """
        select 'M' || cast(n_nationkey as varchar) as MaterialID, n_name as MaterialName,
               n_nationkey % 4 = 3 as IsHazardous,
               case n_regionkey when 0 then 'A' when 1 then 'B' when 2 then 'C'
                                when 3 then 'D' end as RecyclableGrade
        from nation""",
    "suppliers": """
        select 'S' || cast(s_suppkey as varchar) as SupplierID, s_name as SupplierName
        from supplier
        union all
        select 'N' || cast(s_suppkey as varchar), s_name from supplier where s_suppkey % 10 = 0""",
    "product_instances": """
        select c_custkey + 1 as InstanceID, c_name as SerialNumber,
               'P' || cast(c_custkey as varchar) as ProductID
        from customer""",
    "lifecycle_events": """
        select event_id as EventID,
               case event_type when 'signup' then 'Manufactured' when 'purchase' then 'Sold'
                               when 'click' then 'Repair' when 'error' then 'Disposed'
                               else case when event_id % 3 = 0 then 'Recycled_Hazardous'
                                         else 'Recycled' end end as EventType,
               ts as EventDate,
               user_id * 10 + event_id % 7 + 1 as InstanceID
        from events""",
    "event_days": """
        select cast(a as timestamp) as first, cast(a + cast((z - a + 1) // 2 as integer) as timestamp) as middle
        from (select cast(min(ts) as date) as a, cast(max(ts) as date) as z from events) t""",
    "bill_of_material": f"""
        select {ASSEMBLY} as ParentComponentID,
               'X' || cast(l_partkey as varchar) as ChildComponentID,
               cast(sum(l_quantity) as integer) as Quantity
        from lineitem join orders on l_orderkey = o_orderkey
        group by 1, 2""",
    "component_composition": """
        select 'X' || cast(l_partkey as varchar) as ComponentID,
               'M' || cast(s_nationkey as varchar) as MaterialID,
               cast(sum(cast(l_quantity as decimal(10,2))) as decimal(10,2)) as WeightInGrams
        from lineitem join supplier on l_suppkey = s_suppkey
        group by 1, 2""",
    "sourcing": """
        select distinct cast(null as bigint) as SourcingID,
               'S' || cast(l_suppkey as varchar) as SupplierID,
               case when not mat then 'X' || cast(l_partkey as varchar) end as ComponentID,
               case when mat then 'M' || cast(l_partkey % 25 as varchar) end as MaterialID
        from (select l_suppkey, l_partkey,
                     l_suppkey % 3 = 1 or (l_suppkey % 3 = 2 and l_partkey % 2 = 1) as mat
              from lineitem) t""",
    "composition_candidates": """
        select l_orderkey, l_linenumber,
               case when l_quantity = 7 then 'Y' else 'X' end || cast(l_partkey as varchar) as ComponentID,
               'M' || cast(cast((s_nationkey + l_linenumber - 1) % 27 as bigint) as varchar) as MaterialID,
               cast(l_quantity * 12 - 30 as decimal(10,2)) as WeightInGrams
        from lineitem join supplier on l_suppkey = s_suppkey""",
    "sourcing_requests": """
        select l_orderkey, l_linenumber,
               case when l_linenumber = 7 then 'U' else 'S' end || cast(l_suppkey as varchar) as SupplierID,
               case l_returnflag when 'R' then 'component' when 'A' then 'material'
                                 else 'part' end as supply_type,
               case when l_linenumber = 6 then null
                    when l_returnflag = 'A' then 'M' || cast(l_partkey % 27 as varchar)
                    when l_linenumber = 5 then 'Y' || cast(l_partkey as varchar)
                    else 'X' || cast(l_partkey as varchar) end as item_id
        from lineitem""",
    "registration_requests": """
        select o_orderkey as RequestID,
               case when o_orderstatus = 'O'
                    then ' customer#' || lpad(cast(o_custkey as varchar), 9, '0') || ' '
                    else 'SN-' || cast(o_custkey as varchar) end as SerialNumber,
               case when o_orderstatus = 'P' then 'Q' || cast(o_orderkey as varchar)
                    else 'P' || cast(o_orderkey as varchar) end as ProductID
        from orders""",
    "supplier_requests": """
        select c_custkey as RequestID,
               ' ' || case when c_nationkey = 2 then null
                           when c_mktsegment = 'BUILDING' then 'S' || cast(c_nationkey as varchar)
                           else 's' || cast(c_custkey as varchar) end || ' ' as SupplierID,
               case when c_nationkey <> 3 then c_name end as SupplierName
        from customer""",
    "event_requests": """
        select event_id as RequestID,
               cast(user_id * 11 + event_id % 7 + 1 as varchar) as InstanceRef,
               case event_type when 'signup' then 'Sold' when 'purchase' then 'Sold'
                               when 'click' then 'Repair' when 'error' then 'Disposed'
                               else 'Recycled' end as EventType
        from events
        where ts >= (select middle from event_days)""",
}

ORDER = list(VIEWS)


def _deps(name: str) -> set[str]:
    body = VIEWS[name]
    return {v for v in VIEWS if v != name and re.search(rf"\b{v}\b", body)}


def with_views(sql: str, extra_ctes: str = "") -> str:
    """Prefix ``sql`` with the view CTEs it (transitively) mentions.

    ``extra_ctes`` are further ``name as (...)`` definitions that come after
    the views and may use them.
    """
    text = sql + " " + extra_ctes
    need = {v for v in VIEWS if re.search(rf"\b{v}\b", text)}
    frontier = list(need)
    while frontier:
        for d in _deps(frontier.pop()):
            if d not in need:
                need.add(d)
                frontier.append(d)
    ctes = [f"{v} as ({VIEWS[v]}\n    )" for v in ORDER if v in need]
    if extra_ctes:
        ctes.append(extra_ctes)
    if not ctes:
        return sql
    return "with " + ",\n".join(ctes) + "\n" + sql
