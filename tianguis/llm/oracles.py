"""SQL that the queries expressible in it must agree with."""

from __future__ import annotations

_SHINGLES = """
  select {id}, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                         when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s
  from (select {id}, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') as w
        from {table})"""

CONTAINED = f"""
with d as ({_SHINGLES.format(id='doc_id', table='documents')}),
     b as ({_SHINGLES.format(id='item_id', table='benchmark')}),
     n as (select item_id, count(*) as n_item from b group by item_id),
     m as (select doc_id, item_id, count(*) as n_shared from d join b using (s) group by doc_id, item_id)
select doc_id, item_id, n_shared, n_item, n_shared / n_item as containment
from m join n using (item_id) where n_shared >= 0.8 * n_item"""

EQUAL_TEXTS = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents) window w as (partition by t)"""

ORACLES = {"op10_benchmark_decontamination": CONTAINED, "op11_exact_dedup": EQUAL_TEXTS}
