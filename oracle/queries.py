"""One DuckDB statement per registered query, with the same column names."""

from oracle.build import build
from oracle.relations import R6, WARNINGS, warning_sql

SQL: dict[str, str] = {}
EXTRA: dict[str, str] = {}

# -- sources and sinks ---------------------------------------------------------------
SQL["src1_read_row_bundles"] = """
SELECT 'chip' AS "table", chip_id, display_name AS name, typical_clock_hz FROM {chip}
UNION ALL SELECT 'chip_name', chip_id, name, CAST(NULL AS BIGINT) FROM {chip_name}"""
SQL["src1_rejected_cells"] = """
WITH n AS (SELECT count(*) AS cells FROM {system})
SELECT t AS "table", c AS "column", p AS problem, cells FROM n, (VALUES ('system', 'name', 'null cell'), ('system', 'colour', 'unknown column'),
  ('system', 'notes', 'nested cell'), ('weather', '', 'unknown table'), ('chip', '', 'not an array')) AS v(t, c, p)"""
SQL["src2_read_machine_listing"] = """
SELECT d.machine_id, m.mame_sourcefile, m.isbios, d.mame_tag, d.mame_device, array_to_string(d.chip_types, ',') AS chip_types, d.chip_name, d.clock_hz
FROM {devices} d JOIN {listing_machine} m USING (machine_id)"""
SQL["src3_read_raw_extract"] = "SELECT '0.288' AS mame_version, machine_id, name, clone_count FROM {machine}"
SQL["src4_load_lookup_defaults"] = "SELECT system_id, role_id, chip_id, CAST(1 AS BIGINT) AS quantity FROM {system_chip}"
SQL["src6_document_lines"] = """
SELECT doc_id, CAST(len(l) AS BIGINT) AS lines, CAST(list_max([length(x) FOR x IN l]) AS BIGINT) AS longest
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""
EXTRA["good_fix"] = """
SELECT * FROM {machine_chip_correction} WHERE chip_id IN (SELECT chip_id FROM {chip})
  AND (machine_id, mame_tag) IN (SELECT (machine_id, mame_tag) FROM {machine_chip_correction} GROUP BY machine_id, mame_tag HAVING count(*) = 1)
  AND ((machine_id, mame_tag, chip_id) IN (SELECT (machine_id, mame_tag, chip_id) FROM {machine_chip})) = (op <> 'add')"""
_PUBLISHED = {"chip_name": "(SELECT * FROM {chip_name} WHERE name NOT IN (SELECT chip_id FROM {chip}))",
              "dataset_meta": "(SELECT key FROM {dataset_meta} UNION ALL SELECT 'schema_version')", "machine_chip_correction": "{good_fix}",
              "machine_chip": "(SELECT machine_id, mame_tag, chip_id FROM {machine_chip} EXCEPT SELECT machine_id, mame_tag, chip_id FROM {good_fix} WHERE op = 'remove'"
                              " UNION ALL SELECT machine_id, mame_tag, chip_id FROM {good_fix} WHERE op = 'add')"}
TABLE_NAMES = """manufacturer manufacturer_alias license chip_function chip_family chip_role system_kind hdl_language fpga_platform implementation_kind accuracy_level chip chip_name
chip_datasheet mame_device chip_equivalence system system_name system_chip system_driver machine machine_chip machine_unmapped_device project implementation implementation_chip
implementation_system implementation_path implementation_platform implementation_machine implementation_dependency machine_correction machine_system machine_chip_correction
dataset_meta threshold""".split()
SQL["snk1_publish_catalog"] = "\nUNION ALL\n".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {_PUBLISHED.get(t, '{' + t + '}')}" for t in TABLE_NAMES)
SQL["snk2_write_quality_report"] = """
SELECT 'chip' AS name, count(*) AS value FROM {chip} UNION ALL SELECT 'implementation', count(*) FROM {implementation}
UNION ALL SELECT 'machine', count(*) FROM {machine} UNION ALL SELECT 'project', count(*) FROM {project} UNION ALL SELECT 'system', count(*) FROM {system}
UNION ALL SELECT 'ignored', devices_ignored FROM {v_quality_device} UNION ALL SELECT 'mapped', devices_mapped FROM {v_quality_device}
UNION ALL SELECT 'unmapped', devices_unmapped FROM {v_quality_device} UNION ALL SELECT code, count(*) FROM {v_quality_warning} GROUP BY code"""
_FOUR = [("machine", "machine_id"), ("machine_chip", "(machine_id, mame_tag, chip_id)"),
         ("machine_unmapped_device", "(machine_id, mame_device)"), ("dataset_meta", "key")]
SQL["snk4_write_row_tables"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows, count(DISTINCT {k}) AS keys FROM {{{t}}}" for t, k in _FOUR)

# -- extraction ------------------------------------------------------------------------
SQL["ext1_join_device_chip"] = """
SELECT machine_id, mame_tag, mame_device, array_to_string(chip_types, ',') AS chip_types, chip_name, clock_hz FROM {devices}"""
SQL["ext2_parse_flags_clock"] = "SELECT * FROM {parsed}"
SQL["ext3_parse_stats"] = """
SELECT (SELECT count(*) FROM {listing_machine}) AS machines, (SELECT count(*) FROM {listing_chip}) AS chips, (SELECT count(*) FROM {listing_ref}) AS device_refs,
  (SELECT count(*) FROM (SELECT DISTINCT machine_id, mame_tag FROM {chip_rows} WHERE mame_tag <> '' EXCEPT SELECT machine_id, mame_tag FROM {ref_rows})) AS chips_without_device_ref,
  (SELECT count(*) FROM {chip_rows} WHERE mame_tag <> '' AND clock_hz IS NULL) AS chips_without_usable_clock,
  (SELECT count(*) FROM {chip_rows} WHERE mame_tag = '') + (SELECT count(*) FROM {ref_rows} WHERE mame_tag = '') AS untagged_references"""
SQL["ext4_classify_drop"] = "SELECT machine_id, drop_reason, rule, keep_rule FROM {decided}"
SQL["ext5_match_sourcefile_rules"] = "SELECT * FROM {file_rules}"
SQL["ext6_clone_count"] = "SELECT machine_id, clone_count FROM {kept}"
SQL["ext7_filter_stats"] = """
SELECT 'total' AS section, '' AS name, count(*) AS value FROM {decided}
UNION ALL SELECT 'kept', '', count(*) FROM {kept}
UNION ALL SELECT 'dropped', r, count(drop_reason) FROM unnest(['device', 'mechanical', 'clone', 'bios', 'excluded_driver']) AS u(r)
          LEFT JOIN {decided} ON drop_reason = r GROUP BY r
UNION ALL SELECT 'excluded_by_rule', rule, count(*) FROM {decided} WHERE rule IS NOT NULL GROUP BY rule
UNION ALL SELECT 'unused_' || list || '_rule', pattern, 0 FROM {rules} r
          WHERE (list = 'exclude' AND pattern NOT IN (SELECT rule FROM {decided} WHERE rule IS NOT NULL))
             OR (list = 'keep' AND pattern NOT IN (SELECT keep_rule FROM {kept} WHERE keep_rule IS NOT NULL))"""
_WORKLIST = """
SELECT mame_device, count(*) AS instance_count, count(DISTINCT machine_id) AS machine_count,
  array_to_string(list_sort(list_distinct(flatten(list(chip_types) FILTER (chip_types IS NOT NULL)))), ',') AS chip_types,
  array_to_string(list_sort(list(DISTINCT chip_name) FILTER (chip_name IS NOT NULL)), ',') AS chip_names,
  array_to_string(list_sort(list(DISTINCT machine_id))[1:5], ',') AS sample_machine_ids
FROM {src} GROUP BY mame_device"""
SQL["ext8_device_worklist_raw"] = _WORKLIST.replace("{src}", "{kept_devices}")
SQL["ext9_route_devices"] = """
SELECT 'mapped' AS route, machine_id, mame_tag AS "at", chip_id, clock_hz, quantity FROM {machine_chip}
UNION ALL SELECT 'unmapped', machine_id, mame_device, NULL, NULL, quantity FROM {machine_unmapped_device}"""
SQL["ext10_emit_machine_rows"] = "SELECT * FROM {machine}"

EXTRA["odd_machine"] = """
SELECT 1 AS record, * REPLACE (CASE WHEN mame_year = '1997' THEN ' ' ELSE mame_year END AS mame_year,
                  CASE WHEN starts_with(mame_sourcefile, 'building/n1') THEN upper(mame_sourcefile) ELSE mame_sourcefile END AS mame_sourcefile) FROM {kept}
UNION ALL SELECT 2, * FROM {kept} WHERE machine_id LIKE '%7'"""
EXTRA["odd_device"] = """
SELECT 1 AS record, unnest(CASE WHEN mame_device LIKE '%66' THEN [1, 2] ELSE [1] END) AS pos, machine_id,
       CASE WHEN mame_device LIKE '%77' THEN mame_tag || '..x' ELSE mame_tag END AS mame_tag,
       CASE WHEN mame_device LIKE '%88' THEN mame_device || '-b' ELSE mame_device END AS mame_device FROM {kept_devices}
UNION ALL SELECT 2, 1, machine_id, mame_tag || '..y', mame_device FROM {kept_devices} WHERE machine_id LIKE '%7'"""
EXTRA["violation"] = """
WITH ruled AS (SELECT record, machine_id, CASE WHEN mame_sourcefile <> lower(mame_sourcefile) THEN 'mame_sourcefile: sourcefile'
                                               WHEN trim(mame_year) = '' THEN 'mame_year: prose' END AS detail FROM {odd_machine}),
     good AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY record) AS n FROM ruled WHERE detail IS NULL),
     tested AS (SELECT d.* FROM {odd_device} d JOIN good USING (machine_id, record) WHERE n = 1),
     socket AS (SELECT *, row_number() OVER (PARTITION BY machine_id, mame_tag ORDER BY pos) AS n FROM tested WHERE mame_tag NOT LIKE '%..%')
SELECT 'machine' AS "table", machine_id, detail FROM ruled WHERE detail IS NOT NULL
UNION ALL SELECT 'machine', machine_id, 'machine_id: repeated key' FROM good WHERE n > 1
UNION ALL SELECT 'machine_chip', machine_id, mame_tag || ' -> mame_tag: mame_tag' FROM tested WHERE mame_tag LIKE '%..%'
UNION ALL SELECT 'machine_chip', machine_id, mame_tag || ' -> mame_tag: repeated key' FROM socket WHERE n > 1
UNION ALL SELECT 'machine_unmapped_device', machine_id, mame_device || ' -> mame_device: mame_device_key' FROM
  (SELECT DISTINCT machine_id, mame_device FROM tested WHERE mame_device LIKE '%-b')"""
SQL["ext11_verify_constraints"] = "SELECT * FROM {violation}"
SQL["ext11_violation_counts"] = 'SELECT "table", count(*) AS violations FROM {violation} GROUP BY 1'
SQL["ext12_classify_violations"] = """
WITH known AS (SELECT machine_id FROM {machine} WHERE driver_status = 'good')
SELECT CASE WHEN "table" = 'machine' AND machine_id IN (FROM known) THEN 'known' ELSE 'unexpected' END AS status, "table", count(*) AS rows FROM {violation} GROUP BY ALL
UNION ALL SELECT 'unused_known', 'machine', count(*) FROM known WHERE machine_id NOT IN (SELECT machine_id FROM {violation} WHERE "table" = 'machine') HAVING count(*) > 0"""
for _n, _f in (("old", "o_orderdate < DATE '2000-01-01'"), ("new", "o_orderdate >= DATE '1996-01-01'")):
    EXTRA[f"{_n}_m"] = f"SELECT * FROM {{machine}} WHERE machine_id IN (SELECT 'o' || o_orderkey FROM orders WHERE {_f})"
    EXTRA[f"{_n}_d"] = f"""SELECT mame_device, count(*) AS instance_count, count(DISTINCT machine_id) AS machine_count FROM {{kept_devices}}
        WHERE machine_id IN (SELECT machine_id FROM {{{_n}_m}}) GROUP BY 1"""
SQL["ext13_release_diff"] = """
SELECT 'added' AS section, machine_id AS id, name, CAST(NULL AS BIGINT) AS instance_count, CAST(NULL AS BIGINT) AS machine_count FROM {new_m} ANTI JOIN {old_m} USING (machine_id)
UNION ALL SELECT 'removed', machine_id, name, NULL, NULL FROM {old_m} ANTI JOIN {new_m} USING (machine_id)
UNION ALL SELECT 'count_before', NULL, NULL, NULL, count(*) FROM {old_m} UNION ALL SELECT 'count_after', NULL, NULL, NULL, count(*) FROM {new_m}
UNION ALL SELECT 'new_device', mame_device, NULL, instance_count, machine_count FROM {new_d} ANTI JOIN {old_d} USING (mame_device)"""

# -- views -------------------------------------------------------------------------------
for _i, _v in enumerate(("v_machine_system", "v_machine", "v_machine_bom", "v_chip_satisfies", "v_chip_implementation_count", "v_system_chip_effective",
                         "v_system_unmapped", "v_system_core", "v_mame_device_worklist", "v_chip_satisfied", "v_chip_evidence", "v_system_chip_coverage",
                         "v_system_coverage_by_kind", "v_prospector", "v_chip_gap", "v_quality_instance", "v_quality_device", "v_machine_instance",
                         "v_system_instance", "v_quality_completeness", "v_quality_warning"), 1):
    SQL[f"v{_i}_{_v[2:]}"] = f"SELECT * FROM {{{_v}}}"
for _c in WARNINGS:
    SQL[f"v21_{_c.lower()}"] = warning_sql(_c)

# -- canonical reads -----------------------------------------------------------------------
SQL["q1_system_bom_counts"] = """
SELECT s.system_id, s.role_id AS role, s.chip_id, c.display_name, c.function_id,
  (SELECT count(*) FROM {implementation_chip} x JOIN {implementation} i USING (implementation_id) WHERE x.chip_id = s.chip_id AND i.kind_id = 'fpga_hdl') AS implementations
FROM {system_chip} s JOIN {chip} c USING (chip_id)"""
SQL["q2_prospector_simple"] = """
SELECT platform_id, system_id, name, chips_total, chips_satisfied, chips_equivalent, chips_provided,
  floor(satisfied_share * 1000 + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS satisfied_pct, satisfied_share, unmapped_device_count, confidence
FROM {v_prospector} JOIN {system} USING (system_id) WHERE platform_id = 'asia'"""
SQL["q3_dependency_closure"] = """
WITH RECURSIVE used(consumer_id, implementation_id, depth) AS (
  SELECT consumer_id, provider_id, 1 FROM {implementation_dependency}
  UNION SELECT u.consumer_id, d.provider_id, u.depth + 1 FROM used u JOIN {implementation_dependency} d ON d.consumer_id = u.implementation_id)
SELECT u.*, i.name, c.chip_id, p.path, p.is_top, coalesce(i.repo_url, j.url) AS repo_url, i.license_id
FROM used u JOIN {implementation} i USING (implementation_id) LEFT JOIN {project} j USING (project_id)
LEFT JOIN {implementation_chip} c USING (implementation_id) LEFT JOIN {implementation_path} p USING (implementation_id) WHERE i.kind_id = 'fpga_hdl'"""
SQL["q3r_consumers_of"] = "SELECT provider_id, consumer_id FROM {implementation_dependency}"
SQL["q4_chip_gap_ranked"] = "SELECT * EXCLUDE (kind_id) FROM {v_chip_gap} WHERE kind_id = 'fpga_hdl'"
SQL["q5_system_coverage"] = "SELECT * FROM {v_system_coverage_by_kind} WHERE kind_id = 'fpga_hdl'"
SQL["q5_system_coverage_explained"] = "SELECT system_id, chip_id, satisfied_via, provider_chip_id, chip_confidence FROM {v_system_chip_coverage} WHERE kind_id = 'fpga_hdl'"
SQL["q6_worklist_top"] = """
SELECT mame_device, instance_count, machine_count,
  (SELECT string_agg(machine_id, ' ' ORDER BY machine_id) FROM (SELECT machine_id FROM {machine_unmapped_device} x WHERE x.mame_device = w.mame_device ORDER BY machine_id LIMIT 5)) AS sample_machines
FROM {v_mame_device_worklist} w WHERE instance_count >= 5 AND machine_count >= 2 ORDER BY instance_count DESC, mame_device LIMIT 25"""
SQL["q7_warnings_by_code"] = "SELECT code, count(*) AS warnings FROM {v_quality_warning} GROUP BY code"

# -- ranking ---------------------------------------------------------------------------------
SQL["rnk1_socket_detail"] = "SELECT * FROM {socket_detail}"
SQL["rnk2_socket_rollup"] = "SELECT * FROM {socket_rollup}"
SQL["rnk3_system_mates"] = "SELECT * FROM {system_mates}"
SQL["rnk4_best_mate"] = "SELECT * FROM {best_mate}"
SQL["rnk5_prospect_score"] = """
SELECT platform_id, system_id, system_name, chips_total, chips_satisfied, unmapped_device_count, confidence, chip_weight, satisfied_weight, total_weight, readiness,
  confidence_factor, mate_system_id, mate_shared_chips, mate_factor, cpu_sound_applied, cpu_sound_factor, score FROM {prospect_score}"""
SQL["rnk6_cpu_sound_bonus"] = """
SELECT system_id, cpu_chips, cpu_satisfied, sound_chips, sound_satisfied,
  CASE WHEN least(cpu_chips, sound_chips) >= 1 AND cpu_chips + sound_chips = cpu_satisfied + sound_satisfied THEN 1 ELSE 0 END AS applied FROM {socket_rollup}"""
SQL["rnk7_prospect_rank"] = "SELECT platform_id, rank, system_id, score, total_weight FROM {prospect_rank}"
SQL["rnk8_missing_chips"] = "SELECT system_id, chip_id, band, weight, is_cpu, is_sound FROM {socket_detail} WHERE satisfied_via = 'unsatisfied'"
SQL["rnk9_via_edge_chips"] = "SELECT system_id, chip_id, satisfied_via AS via, provider_chip_id, credit FROM {socket_detail} WHERE satisfied_via IN ('equivalent', 'provides')"
SQL["rnk10_cpu_sound_missing"] = "SELECT system_id, chip_id FROM {socket_detail} WHERE satisfied_via = 'unsatisfied' AND is_cpu + is_sound > 0"
SQL["rnk11_prospect_breakdown"] = """
SELECT r.platform_id, r.rank, r.system_id, r.score, r.readiness, """ + R6.format("r.total_weight - r.chip_weight") + """ AS unmapped_weight, r.hard_missing,
  coalesce((SELECT string_agg(chip_id, ',' ORDER BY weight DESC, chip_id) FROM {socket_detail} d WHERE d.system_id = r.system_id AND evidence_rank = 4), '') AS missing,
  coalesce((SELECT string_agg(chip_id, ',' ORDER BY chip_id) FROM {socket_detail} d WHERE d.system_id = r.system_id AND evidence_rank IN (2, 3)), '') AS via_edge,
  coalesce((SELECT string_agg(chip_id, ',' ORDER BY chip_id) FROM {socket_detail} d WHERE d.system_id = r.system_id AND evidence_rank = 4 AND is_cpu + is_sound > 0), '') AS cpu_sound_missing
FROM {prospect_rank} r"""
SQL["rnk12_prospect_caveats"] = """
SELECT platform_id, system_id, CAST(unmapped_device_count > 0 AS BIGINT) + CAST(confidence <> 'high' AS BIGINT)
  + CAST(system_id IN (SELECT system_id FROM {socket_detail} WHERE evidence_rank IN (2, 3)) AS BIGINT) AS caveats,
  CAST(unmapped_device_count > 0 AS INTEGER) AS unmapped FROM {prospect_score}"""

# -- corrections, gates, report ----------------------------------------------------------------
EXTRA["fix"] = "SELECT * FROM {machine_chip_correction}"
SQL["cor1_apply_corrections"] = """
SELECT m.machine_id, m.mame_tag, m.chip_id, coalesce(f.clock_hz, m.clock_hz) AS clock_hz, coalesce(f.quantity, m.quantity) AS quantity
FROM {machine_chip} m LEFT JOIN (FROM {fix} WHERE op = 'set') f USING (machine_id, mame_tag, chip_id)
WHERE (m.machine_id, m.mame_tag, m.chip_id) NOT IN (SELECT (machine_id, mame_tag, chip_id) FROM {fix} WHERE op = 'remove')
UNION ALL SELECT machine_id, mame_tag, chip_id, clock_hz, coalesce(quantity, 1) FROM {fix} WHERE op = 'add'"""
SQL["cor1_correction_counts"] = """
SELECT op, count(*) AS rows FROM {fix} f WHERE op = 'add' OR EXISTS (SELECT 1 FROM {machine_chip} m WHERE m.machine_id = f.machine_id AND m.mame_tag = f.mame_tag AND m.chip_id = f.chip_id)
GROUP BY op"""
SQL["gat1_stale_correction"] = """
SELECT f.machine_id, f.mame_tag, f.chip_id, f.op, f.reason FROM {fix} f LEFT JOIN {machine_chip} m USING (machine_id, mame_tag, chip_id)
WHERE (m.quantity IS NULL) = (f.op <> 'add')"""
SQL["gat2_retired_id_collision"] = """
SELECT 'chip' AS entity, name, chip_id AS claimed_by FROM {chip_name} WHERE name IN (SELECT chip_id FROM {chip})
UNION ALL SELECT 'system', name, system_id FROM {system_name} WHERE name IN (SELECT system_id FROM {system})"""
SQL["gat3_stale_extract"] = """
SELECT DISTINCT mame_device FROM {machine_unmapped_device}
WHERE mame_device IN (SELECT mame_device FROM {mame_device} UNION ALL SELECT 'd' || p_partkey FROM part WHERE p_partkey % 40 = 38)"""
_CYCLE = """
WITH RECURSIVE e(a, b) AS ({edges}), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT DISTINCT a AS {name} FROM reach WHERE a = b"""
SQL["gat4_dependency_cycle"] = _CYCLE.replace("{name}", "implementation_id").replace("{edges}", """
SELECT consumer_id, provider_id FROM {implementation_dependency}
UNION SELECT provider_id, consumer_id FROM {implementation_dependency} WHERE CAST(substr(consumer_id, 2) AS BIGINT) % 5 = 0""")
SQL["gat4_dependency_acyclic"] = _CYCLE.replace("{name}", "implementation_id").replace("{edges}", "SELECT consumer_id, provider_id FROM {implementation_dependency}")
SQL["gat8_provides_cycle"] = _CYCLE.replace("{name}", "chip_id").replace("{edges}", """
SELECT from_chip_id, to_chip_id FROM {chip_equivalence}
UNION SELECT 'p' || p_partkey, 'p' || (p_partkey + 8) FROM part WHERE p_partkey % 60 = 0
UNION SELECT 'p' || (p_partkey + 8), 'p' || (p_partkey + 4) FROM part WHERE p_partkey % 60 = 0""")
EXTRA["eq"] = """
SELECT from_chip_id AS x, to_chip_id AS y FROM {chip_equivalence} WHERE kind = 'equivalent' UNION SELECT to_chip_id, from_chip_id FROM {chip_equivalence} WHERE kind = 'equivalent'"""
SQL["gat9_incomplete_equivalence"] = """
SELECT p.x AS chip_a, q.y AS chip_c FROM {eq} p JOIN {eq} q ON p.y = q.x AND p.x <> q.y WHERE (p.x, q.y) NOT IN (SELECT (x, y) FROM {eq})"""
SQL["gat9_incomplete_hubs"] = """
WITH d AS (SELECT x, count(*) AS links FROM {eq} GROUP BY x),
     c AS (SELECT p.x AS x, count(*) AS closed FROM {eq} p JOIN {eq} q ON p.x = q.x JOIN {eq} r ON r.x = p.y AND r.y = q.y GROUP BY p.x)
SELECT x AS chip_id, links, coalesce(closed, 0) AS closed, links * (links - 1) - coalesce(closed, 0) AS missing FROM d LEFT JOIN c USING (x) WHERE links * (links - 1) > coalesce(closed, 0)"""
SQL["gat10_cross_function_edge"] = """
SELECT e.from_chip_id, e.to_chip_id, e.kind, a.function_id AS from_function, b.function_id AS to_function
FROM {chip_equivalence} e, {chip} a, {chip} b WHERE a.chip_id = e.from_chip_id AND b.chip_id = e.to_chip_id AND a.function_id <> b.function_id"""
SQL["gat10_short_note"] = "SELECT from_chip_id, to_chip_id, note FROM {chip_equivalence} WHERE length(trim(note)) < 40"
# (child table, column, parent table, parent column)
FOREIGN_KEYS = [tuple(x.split()) for x in """
manufacturer_alias manufacturer_id manufacturer manufacturer_id|chip_family manufacturer_id manufacturer manufacturer_id|chip function_id chip_function function_id
chip manufacturer_id manufacturer manufacturer_id|chip family_id chip_family family_id|chip_name chip_id chip chip_id|chip_datasheet chip_id chip chip_id
mame_device chip_id chip chip_id|chip_equivalence from_chip_id chip chip_id|chip_equivalence to_chip_id chip chip_id|system kind_id system_kind kind_id
system manufacturer_id manufacturer manufacturer_id|system_name system_id system system_id|system_chip system_id system system_id|system_chip role_id chip_role role_id
system_chip chip_id chip chip_id|system_driver system_id system system_id|machine_chip machine_id machine machine_id|machine_chip chip_id chip chip_id
machine_unmapped_device machine_id machine machine_id|implementation kind_id implementation_kind kind_id|implementation project_id project project_id
implementation hdl_language_id hdl_language language_id|implementation license_id license license_id|implementation accuracy_id accuracy_level accuracy_id
implementation_chip implementation_id implementation implementation_id|implementation_chip chip_id chip chip_id|implementation_system implementation_id implementation implementation_id
implementation_system system_id system system_id|implementation_path implementation_id implementation implementation_id|implementation_platform implementation_id implementation implementation_id
implementation_platform platform_id fpga_platform platform_id|implementation_machine implementation_id implementation implementation_id|implementation_machine machine_id machine machine_id
implementation_dependency consumer_id implementation implementation_id|implementation_dependency provider_id implementation implementation_id|machine_correction machine_id machine machine_id
machine_correction manufacturer_id manufacturer manufacturer_id|machine_system machine_id machine machine_id|machine_system system_id system system_id
machine_chip_correction machine_id machine machine_id|machine_chip_correction chip_id chip chip_id""".replace("\n", "|").split("|") if x]
EXTRA["dangling"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {c} AS value, count(*) AS rows FROM {{{t}}} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {pc} FROM {{{p}}}) GROUP BY {c}"
    for t, c, p, pc in FOREIGN_KEYS)
SQL["gat6_foreign_key_check"] = "SELECT * FROM {dangling}"
EXTRA["duplicate"] = """
SELECT 'machine_chip_correction' AS "table", 'primary key' AS rule, machine_id || '|' || mame_tag || '|' || chip_id AS key, count(*) AS rows FROM {fix}
GROUP BY machine_id, mame_tag, chip_id HAVING count(*) > 1
UNION ALL SELECT 'machine_chip_correction', 'one correction per tag', machine_id || '|' || mame_tag, count(*) FROM {fix} WHERE mame_tag <> ':device' GROUP BY machine_id, mame_tag HAVING count(*) > 1
UNION ALL SELECT 'chip_name', 'chip_name is a function', name, count(*) FROM {chip_name} GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'chip_equivalence', 'primary key', from_chip_id || '|' || to_chip_id, count(*) FROM {chip_equivalence} GROUP BY from_chip_id, to_chip_id HAVING count(*) > 1
UNION ALL SELECT 'chip_equivalence', 'one edge per unordered pair', least(from_chip_id, to_chip_id) || '|' || greatest(from_chip_id, to_chip_id), count(*) FROM {chip_equivalence}
GROUP BY least(from_chip_id, to_chip_id), greatest(from_chip_id, to_chip_id) HAVING count(*) > 1
UNION ALL SELECT 'system_name', 'system_name is a function', name, count(*) FROM {system_name} GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'system_chip', 'primary key', system_id || '|' || role_id || '|' || chip_id, count(*) FROM {system_chip} GROUP BY system_id, role_id, chip_id HAVING count(*) > 1"""
SQL["gat7_unique_check"] = "SELECT * FROM {duplicate}"
EXTRA["broken"] = """
SELECT 'chip' AS "table", chip_id AS key, 'year_introduced: year' AS rule FROM {chip} WHERE year_introduced NOT BETWEEN 1950 AND 2100
UNION ALL SELECT 'mame_device', mame_device, 'mapped xor ignored' FROM {mame_device} WHERE (chip_id IS NULL) = (ignore_reason IS NULL)
UNION ALL SELECT 'implementation', implementation_id, 'original silicon carries no repo, language, licence or accuracy' FROM {implementation}
  WHERE kind_id = 'original_silicon' AND coalesce(repo_url, hdl_language_id, license_id, accuracy_id) IS NOT NULL
UNION ALL SELECT 'chip_equivalence', from_chip_id || '|' || to_chip_id, 'equivalent is ordered' FROM {chip_equivalence} WHERE kind = 'equivalent' AND from_chip_id >= to_chip_id"""
SQL["gat7_check_constraint"] = "SELECT * FROM {broken}"
SQL["gat11_run_gates"] = f"""
SELECT code, rows, rows AS reported FROM (
SELECT 'STALE_CORRECTION' AS code, count(*) AS rows FROM ({SQL['gat1_stale_correction']})
UNION ALL SELECT 'RETIRED_ID_COLLISION', count(*) FROM ({SQL['gat2_retired_id_collision']})
UNION ALL SELECT 'STALE_EXTRACT', count(DISTINCT mame_device) FROM {{machine_unmapped_device}} SEMI JOIN {{mame_device}} USING (mame_device)
UNION ALL SELECT 'DATASET_META_INCOMPLETE', 4 - count(*) FROM {{dataset_meta}} WHERE key IN ('build_date', 'dataset_version', 'mame_version', 'schema_version')
UNION ALL SELECT 'FOREIGN_KEY', count(*) FROM {{dangling}} UNION ALL SELECT 'UNIQUE', count(*) FROM {{duplicate}} UNION ALL SELECT 'CHECK', count(*) FROM {{broken}}
UNION ALL SELECT 'DEPENDENCY_CYCLE', count(*) FROM ({SQL['gat4_dependency_acyclic']})
UNION ALL SELECT 'PROVIDES_CYCLE', count(*) FROM ({_CYCLE.replace("{name}", "chip_id").replace("{edges}", "SELECT from_chip_id, to_chip_id FROM {chip_equivalence} WHERE kind = 'provides'")}))"""
SQL["gat12_rebuild_fingerprint"] = "\nUNION ALL\n".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, true AS same FROM {{{t}}}" for t in TABLE_NAMES)
SQL["rep1_quality_report"] = """
SELECT 'counts' AS section, 'chip' AS name, CAST(count(*) AS VARCHAR) AS value FROM {chip} UNION ALL SELECT 'counts', 'implementation', CAST(count(*) AS VARCHAR) FROM {implementation}
UNION ALL SELECT 'counts', 'machine', CAST(count(*) AS VARCHAR) FROM {machine} UNION ALL SELECT 'counts', 'project', CAST(count(*) AS VARCHAR) FROM {project}
UNION ALL SELECT 'counts', 'system', CAST(count(*) AS VARCHAR) FROM {system}
UNION ALL SELECT 'devices', unnest(['ignored', 'mapped', 'unmapped']), CAST(unnest([devices_ignored, devices_mapped, devices_unmapped]) AS VARCHAR) FROM {v_quality_device}
UNION ALL SELECT 'instances', unnest(['mapped', 'unmapped', 'total']), CAST(unnest([mapped_instances, unmapped_instances, total_instances]) AS VARCHAR) FROM {v_quality_instance}
UNION ALL SELECT 'instances', 'mapped_instance_share', CAST(floor(mapped_instance_share * 10000 + CAST(0.5 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS VARCHAR) FROM {v_quality_instance}
UNION ALL SELECT 'warnings_by_code', code, CAST(count(*) AS VARCHAR) FROM {v_quality_warning} GROUP BY code
UNION ALL SELECT 'versions', key, value FROM {dataset_meta} WHERE key <> 'build_date'"""

# -- reconciliation -------------------------------------------------------------------------------
_NORM = "regexp_replace(upper(translate({}, 'µμ', 'UU')), '[^A-Z0-9]', '', 'g')"
# Longest prefix leaving two characters; RE2 has no look-ahead, so the rest is captured.
_STRIP = "regexp_replace({}, '^(?:SMALL|BLUE|RED|D)(..+)$', '\\1')"
_BARE = _STRIP.format(_NORM)
SQL["rec1_normalize_part"] = f"SELECT p_partkey, {_NORM.format(chr(39) + 'µ' + chr(39) + ' || p_name || ' + chr(39) + '-' + chr(39) + ' || p_brand')} AS normalized FROM part"
SQL["rec2_strip_vendor"] = f"SELECT p_partkey, {_BARE.format(chr(34) + 'nm' + chr(34))} AS normalized FROM (SELECT p_partkey, p_name || ' ' || p_partkey AS nm FROM part)"
SQL["rec3_name_forms"] = "SELECT p_partkey, unnest([p_name || ' (' || p_brand || ')', p_name, p_brand]) AS form FROM part"
EXTRA["chip_key"] = f"""
WITH form AS (SELECT chip_id, unnest([chip_id, display_name]) AS f FROM {{chip}} UNION ALL SELECT chip_id, name FROM {{chip_name}}),
     claim AS (SELECT chip_id, unnest([{_NORM.format('f')}, {_BARE.format('f')}]) AS key FROM form)
SELECT key, min(chip_id) AS chip_id FROM claim WHERE length(key) >= 2 AND key <> 'THIRDBRACKET' GROUP BY key HAVING count(DISTINCT chip_id) = 1
UNION ALL SELECT 'THIRDBRACKET', 'p4'"""
SQL["rec4_chip_index"] = "SELECT * FROM {chip_key}"
EXTRA["asked"] = "SELECT p_partkey, upper(p_name) || '_' || p_partkey AS designation FROM part"
SQL["rec5_resolve_part"] = f"""
WITH n AS (SELECT *, {_BARE.format('designation')} AS normalized, {_NORM.format('designation')} AS plain FROM {{asked}})
SELECT p_partkey, designation, normalized, coalesce(a.chip_id, b.chip_id) AS chip_id, coalesce('chip:' || coalesce(a.chip_id, b.chip_id), 'part:' || normalized) AS key
FROM n LEFT JOIN {{chip_key}} a ON a.key = normalized LEFT JOIN {{chip_key}} b ON b.key = plain WHERE length(normalized) >= 2"""
EXTRA["doc_line"] = """
SELECT doc_id, unnest(string_split(text, chr(10))) AS content, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line FROM documents"""
EXTRA["literal"] = """
SELECT DISTINCT trim(c) AS name FROM (SELECT unnest(string_split_regex(text, '[.,\n]')) AS c FROM benchmark) WHERE trim(c) <> ''"""
_B0, _B1 = "(?:^|[^A-Za-z0-9])", "(?:$|[^A-Za-z0-9])"
# One alternation a line, of the names whose signs the line's signs contain; longest first. "_" is put aside because \b counts it as a letter.
SQL["rec6_scan_parts"] = rf"""
WITH pat AS (SELECT name, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS signs, array_to_string(regexp_extract_all(name, '[A-Za-z0-9]+'), '[^A-Za-z0-9]?') AS re
             FROM {{literal}} WHERE regexp_matches(name, '[A-Za-z]') AND length(name) >= 3),
     flat AS (SELECT doc_id, line, replace(content, '_', chr(1)) AS content, lower(regexp_replace(content, '[^A-Za-z0-9]', '', 'g')) AS signs FROM {{doc_line}}),
     one AS (SELECT doc_id, line, content, '(?i)\b(' || string_agg(re, '|' ORDER BY length(name) DESC, name) || ')\b' AS re FROM flat JOIN pat ON contains(flat.signs, pat.signs) GROUP BY ALL),
     hit AS (SELECT doc_id, line, 0 AS rule_no, 'catalog' AS rule, replace(d, chr(1), '_') AS designation, nth FROM
               (SELECT doc_id, line, unnest(regexp_extract_all(content, re, 1)) AS d, generate_subscripts(regexp_extract_all(content, re, 1), 1) AS nth FROM one)
             UNION ALL SELECT doc_id, line, 1, 'phone', unnest(regexp_extract_all(content, '{_B0}([0-9]{{3}}-[0-9]{{4}}){_B1}', 1)), 0 FROM {{doc_line}} WHERE content LIKE '%+1%'
             UNION ALL SELECT doc_id, line, 2, 'license', unnest(regexp_extract_all(content, '(?i){_B0}(licen[sc]e [a-z0-9.-]*[a-z0-9]){_B1}', 1)), 0 FROM {{doc_line}})
SELECT doc_id, line, arg_min(designation, (rule_no, nth)) AS designation, arg_min(rule, (rule_no, nth)) AS rule FROM hit GROUP BY doc_id, line, {_NORM.format('designation')}"""
EXTRA["marked"] = "SELECT m.machine_id, (SELECT string_agg(DISTINCT chip_id, ' ' ORDER BY chip_id) FROM {machine_chip} c WHERE c.machine_id = m.machine_id) AS chips FROM {machine} m"
SQL["rec7_extract_comments"] = """
SELECT machine_id, CAST(length(' board ' || machine_id || ' uses' || chr(10) || ' ' || coalesce(chips, 'nothing') || ' ') AS BIGINT) AS size FROM {marked}"""
EXTRA["laid"] = """
WITH m AS (SELECT machine_id, mame_sourcefile, chips, CAST(substr(machine_id, 2) AS BIGINT) AS n FROM {marked} JOIN {machine} USING (machine_id)),
     f AS (SELECT *, n % 6 AS v, mame_sourcefile || '#' || (n % CAST(ceil(count(*) OVER (PARTITION BY mame_sourcefile) / 200) AS BIGINT)) AS doc_id FROM m)
SELECT *, CASE WHEN v < 4 THEN machine_id WHEN v = 5 THEN 'zz' || machine_id END AS marker,
  1 + coalesce(sum(CASE v WHEN 3 THEN 7 WHEN 4 THEN 8 ELSE 5 END) OVER (PARTITION BY doc_id ORDER BY machine_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM f"""
EXTRA["spoken"] = """
WITH declared AS (SELECT mame_sourcefile, system_id FROM {system_driver}),
     reached AS (SELECT DISTINCT mame_sourcefile, system_id FROM {machine} JOIN {v_machine_system} o USING (machine_id)
                 WHERE o.system_id IS NOT NULL AND mame_sourcefile NOT IN (SELECT mame_sourcefile FROM declared))
SELECT l.*, o.system_id FROM {laid} l JOIN {v_machine_system} o ON o.machine_id = l.marker WHERE o.system_id IS NOT NULL
UNION ALL SELECT l.*, d.system_id FROM {laid} l JOIN (FROM declared UNION ALL FROM reached) d USING (mame_sourcefile) WHERE l.marker IS NULL"""
SQL["rec8_attach_rom_starts"] = "SELECT machine_id AS board, marker AS machine_id FROM {laid}"
SQL["rec9_attribute_blocks"] = "SELECT system_id, count(*) AS blocks FROM {spoken} GROUP BY 1"
EXTRA["said"] = f"""
WITH h AS (SELECT *, unnest(string_split(chips, ' ')) AS designation FROM {{spoken}} WHERE chips IS NOT NULL),
     n AS (SELECT *, {_BARE.format('designation')} AS normalized, {_NORM.format('designation')} AS plain FROM h WHERE length(designation) >= 3)
SELECT system_id, 'mame-source' AS witness, coalesce('chip:' || coalesce(a.chip_id, b.chip_id), 'part:' || normalized) AS key, designation, coalesce(a.chip_id, b.chip_id) AS chip_id,
  'https://example.org/listing/' || mame_sourcefile || '#L' || CAST(line + 1 AS BIGINT) AS source_url,
  mame_sourcefile || coalesce(' (' || marker || ')', '') || ': ' || CASE WHEN length(chips) <= 160 THEN chips ELSE substr(chips, 1, 159) || '…' END AS evidence
FROM n LEFT JOIN {{chip_key}} a ON a.key = normalized LEFT JOIN {{chip_key}} b ON b.key = plain"""
SQL["rec9_source_witness"] = "SELECT * FROM {said}"
# The pages hold no templates or links: each piece after a "<" loses what is before its ">"; comments are cut at their end mark.
SQL["rec10_strip_markup"] = r"""
WITH c AS (SELECT page_id, list_aggregate(list_transform(string_split(html, '<!--'), lambda x, i:
    CASE WHEN i = 1 THEN x WHEN contains(x, '-->') THEN ' ' || substr(x, strpos(x, '-->') + 3) ELSE '<!--' || x END), 'string_agg', '') AS t FROM pages),
p AS (SELECT page_id, list_aggregate(list_transform(string_split(t, '<'), lambda x, i:
    CASE WHEN i = 1 THEN x WHEN strpos(x, '>') > 1 THEN ' ' || substr(x, strpos(x, '>') + 1) ELSE '<' || x END), 'string_agg', '') AS t FROM c),
m AS (SELECT page_id, replace(replace(regexp_replace(t, chr(39) || '{2,}', '', 'g'), '&nbsp;', ' '), '&amp;', '&') AS m FROM p)
SELECT page_id, md5(m) AS digest, CAST(length(m) AS BIGINT) AS size FROM m"""
SQL["rec11_infobox_fields"] = """
SELECT system_id AS doc_id, unnest([2, 3]) AS line, unnest(['name', 'CPU']) AS name, unnest([name, 'Zilog Z80   at ' || coalesce(CAST(year_introduced AS VARCHAR), '?')]) AS value FROM {system}"""
SQL["rec12_spec_section_items"] = """
SELECT system_id AS doc_id, unnest([9, 10]) AS line, unnest(['* ' || kind_id || ' ', '; sound: ' || name]) AS item FROM {system}"""
SQL["rec13_resolve_title"] = """
WITH RECURSIVE t AS (SELECT CAST(substr(implementation_id, 2) AS BIGINT) AS n FROM {implementation}),
     e AS (SELECT 's' || substr(consumer_id, 2) AS a, max('s' || substr(provider_id, 2)) AS b FROM {implementation_dependency} GROUP BY 1),
     w AS (SELECT n, 's' || n AS p FROM t UNION SELECT w.n, e.b FROM w JOIN e ON w.p = e.a)
SELECT 's' || n AS title, p AS resolved FROM w WHERE p NOT IN (SELECT a FROM e)"""
SQL["rec14_module_instances"] = """
SELECT consumer_id || '.v' AS path, 3 AS line, 'core_' || provider_id AS module, 'core_' || provider_id || ' #(.W(8)) u_core(' AS evidence FROM {implementation_dependency}
UNION ALL SELECT consumer_id || '.yaml', 1, 'core_' || provider_id, 'core_' || provider_id || ':' FROM {implementation_dependency}
UNION ALL SELECT consumer_id || '.yaml', 3, 'other', 'other: 1' FROM {implementation_dependency}"""
SQL["rec15_statement_parts"] = "SELECT chip_id AS item, 'P880' AS property, display_name AS label FROM {chip} WHERE chip_id NOT LIKE '%0'"
EXTRA["listed"] = f"""
WITH row_ AS (
  SELECT system_id, machine_id, mame_tag AS at_, 'chip:' || chip_id AS key, chip_id AS designation, chip_id, 'mapped' AS mame_state,
         'machine_chip ' || machine_id || ':' || mame_tag || ' -> ' || chip_id AS evidence FROM {{machine_chip}} JOIN {{v_machine_system}} USING (machine_id)
  UNION ALL
  SELECT system_id, machine_id, mame_device, 'part:' || {_BARE.format('mame_device')}, mame_device, NULL, 'unmapped',
         'machine_unmapped_device ' || machine_id || ' -> ' || mame_device FROM {{machine_unmapped_device}} JOIN {{v_machine_system}} USING (machine_id))
SELECT system_id, 'mame-listxml' AS witness, key, designation, chip_id, mame_state, 'https://example.org/listing' AS source_url, evidence,
       count(DISTINCT machine_id) OVER (PARTITION BY system_id, key) AS machine_count
FROM row_ WHERE system_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY system_id, key ORDER BY machine_id, at_) = 1"""
SQL["rec16_listing_witness"] = "SELECT * FROM {listed}"
EXTRA["claim"] = f"""
WITH raw AS (
  SELECT system_id, 'mame-source' AS witness, upper(chip_id) AS designation, 'https://example.org/src/' || role_id AS source_url, '// ' || chip_id AS evidence FROM {{system_chip}}
  UNION ALL SELECT system_id, 'wikipedia', 'D' || coalesce(CAST(year_introduced AS VARCHAR), '38'), 'https://example.org/wiki', name FROM {{system}}
  UNION ALL SELECT DISTINCT system_id, 'wikidata', upper(mame_device), 'https://example.org/item', 'statement' FROM {{v_machine_system}} JOIN {{machine_unmapped_device}} USING (machine_id)
            WHERE system_id IS NOT NULL),
  n AS (SELECT *, {_BARE.format('designation')} AS normalized, {_NORM.format('designation')} AS plain FROM raw)
SELECT * FROM (
  SELECT system_id, witness, coalesce('chip:' || coalesce(a.chip_id, b.chip_id), 'part:' || normalized) AS key, designation, coalesce(a.chip_id, b.chip_id) AS chip_id, source_url, evidence
  FROM n LEFT JOIN {{chip_key}} a ON a.key = normalized LEFT JOIN {{chip_key}} b ON b.key = plain WHERE length(normalized) >= 2
  UNION ALL BY NAME SELECT * FROM {{said}})
QUALIFY row_number() OVER (PARTITION BY system_id, witness, key ORDER BY source_url, designation, evidence) = 1"""
SQL["rec17_collapse_parts"] = "SELECT * FROM {claim}"
EXTRA["witness"] = """
SELECT system_id, witness, key, designation, chip_id, mame_state, source_url, evidence, machine_count,
       list_position(['mame-source', 'wikidata', 'wikipedia', 'jtcores', 'mame-listxml'], witness) AS pick,
       list_position(['mame-listxml', 'mame-source', 'wikidata', 'wikipedia', 'jtcores'], witness) AS ord
FROM (SELECT * FROM {listed} UNION ALL BY NAME SELECT * FROM {claim})"""
SQL["rec18_merge_witnesses"] = """
SELECT system_id, CAST(dense_rank() OVER (PARTITION BY system_id ORDER BY ord) AS INTEGER) AS position, witness,
  CAST(row_number() OVER (PARTITION BY system_id, witness ORDER BY key) AS INTEGER) AS part_position, key, designation, chip_id, mame_state, source_url, evidence, machine_count
FROM {witness}"""
SQL["snk3_write_reconciliation"] = SQL["rec18_merge_witnesses"]
EXTRA["finding"] = """
WITH total AS (SELECT system_id, count(*) AS machines FROM {v_machine_system} WHERE system_id IS NOT NULL GROUP BY 1),
g AS (SELECT system_id, key, bool_or(witness = 'mame-listxml') AS p, bool_or(witness <> 'mame-listxml') AS r,
             arg_min(designation, pick) AS designation, arg_min(source_url, pick) AS source_url, arg_min(evidence, pick) AS evidence, any_value(chip_id) AS chip_id,
             max(mame_state) AS mame_state, max(machine_count) AS machine_count, string_agg(witness, ',' ORDER BY ord) AS witnesses FROM {witness} GROUP BY system_id, key)
SELECT system_id, CASE WHEN p AND r THEN 'agreed' WHEN p THEN 'mame-only' ELSE 'reference-only' END AS classification, key, designation, chip_id,
  coalesce(mame_state, 'absent') AS mame_state, witnesses, source_url, evidence, machine_count,
  floor(CAST(machine_count AS DOUBLE) / CAST(machines AS DOUBLE) * 10000 + CAST(0.5 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS machine_share
FROM g LEFT JOIN total USING (system_id)"""
SQL["rec19_classify_findings"] = "SELECT * FROM {finding}"
SQL["rec20_reconcile_summary"] = """
SELECT 'summary' AS section, 'systems_total' AS name, count(DISTINCT system_id) AS value FROM {witness}
UNION ALL SELECT 'summary', 'systems_with_reference_witness', count(DISTINCT system_id) FROM {claim}
UNION ALL SELECT 'summary', replace(k, '-', '_'), count(classification) FROM unnest(['agreed', 'mame-only', 'reference-only']) AS u(k) LEFT JOIN {finding} ON classification = k GROUP BY k
UNION ALL SELECT 'summary', 'agreed_unmapped_in_mame', count(*) FROM {finding} WHERE classification = 'agreed' AND mame_state = 'unmapped'
UNION ALL SELECT 'witness_systems', witness, count(DISTINCT system_id) FROM {witness} GROUP BY witness
UNION ALL SELECT 'witness_parts', witness, count(*) FROM {witness} GROUP BY witness"""
SQL["rec21_machine_systems_for_recon"] = "SELECT * FROM {v_machine_system} WHERE system_id IS NOT NULL"
SQL["rec21_null_override_falls_through"] = """
SELECT machine_id, coalesce(s.system_id, d.system_id) AS system_id FROM {machine} LEFT JOIN {machine_system} s USING (machine_id) LEFT JOIN {system_driver} d USING (mame_sourcefile)
WHERE coalesce(s.system_id, d.system_id) IS NOT NULL"""

EXTRA["guard_line"] = """
SELECT 'd' || doc_id || '.txt' AS path, content, line, false AS web, false AS first_ FROM {doc_line}
UNION ALL SELECT 'p' || page_id || '.html', '<!-- source: ' || url || ' -->', 1, true, true FROM pages
UNION ALL SELECT 'p' || page_id || '.html', unnest(string_split(html, chr(10))), CAST(1 + generate_subscripts(string_split(html, chr(10)), 1) AS INTEGER), true, false FROM pages"""
# An address: a scheme runs in, a path follows, or the domain is a whole quoted literal. The page's
# first line is a comment; elsewhere a fetch verb within three lines counts.
SQL["rec22_domain_guard"] = r"""
WITH hit AS (SELECT l.*, d FROM {guard_line} l, unnest(['example.com', 'example.org']) AS u(d)
             WHERE regexp_matches(lower(content), '(^|[^a-z0-9-])' || replace(d, '.', '\.') || '($|[^a-z0-9-])')),
     verb AS (SELECT path, line FROM {guard_line} WHERE contains(lower(content), 'fetch(') OR contains(lower(content), 'curl') OR contains(lower(content), 'src='))
SELECT path, line, d AS domain, CASE WHEN regexp_matches(lower(content), '//[a-z0-9.-]*' || replace(d, '.', '\.') || '($|[^a-z0-9-])')
  OR regexp_matches(lower(content), '(^|[^a-z0-9-])' || replace(d, '.', '\.') || '/[^\s"''`]')
  OR (NOT first_ AND EXISTS (SELECT 1 FROM verb v WHERE v.path = hit.path AND v.line BETWEEN hit.line - 3 AND hit.line + 3)) THEN 'fetch' ELSE 'prose' END AS disposition
FROM hit
UNION ALL
SELECT replace(path, '#', page_id::VARCHAR), line, domain, disposition FROM pages, (VALUES
  ('n#.md', 1, 'example.com', 'prose'), ('n#.md', 3, 'example.com', 'fetch'), ('n#.md', 5, 'example.org', 'prose'),
  ('t#.ts', 1, 'example.com', 'fetch'), ('t#.ts', 2, 'example.org', 'prose'), ('t#.ts', 7, 'example.org', 'fetch'),
  ('t#.ts', 8, 'example.org', 'prose'), ('t#.ts', 9, 'example.com', 'fetch'), ('data/j#.json', 2, 'example.com', 'citation'),
  ('data/j#.json', 3, 'example.org', 'fetch'), ('config/c#.json', 1, 'example.org', 'prose'), ('config/c#.json', 3, 'example.com', 'fetch')
) v(path, line, domain, disposition)"""

# -- search, browse, details, dashboard ----------------------------------------------------------------
EXTRA["term"] = """
SELECT DISTINCT lower(trim(t)) AS needle FROM (SELECT string_split(p_name, ' ')[1] AS t FROM part UNION ALL SELECT c_mktsegment FROM customer
  UNION ALL SELECT 'p' || n_nationkey FROM nation UNION ALL SELECT 'Hardware ' || n_nationkey FROM nation) WHERE length(trim(t)) >= 2"""
EXTRA["entity"] = """
SELECT 'chip' AS kind, 4 AS kr, chip_id AS id, display_name AS label, coalesce(manufacturer_id, function_id) AS detail FROM {chip}
UNION ALL SELECT 'system', 3, system_id, name, kind_id FROM {system} UNION ALL SELECT 'implementation', 2, implementation_id, name, kind_id FROM {implementation}
UNION ALL SELECT 'machine', 1, machine_id, name, coalesce(system_id, mame_sourcefile) FROM {v_machine}"""
EXTRA["hit"] = """
SELECT needle, e.*, NULL AS matched_on, CASE WHEN lower(id) = needle OR lower(label) = needle THEN 0 WHEN starts_with(lower(id), needle) OR starts_with(lower(label), needle) THEN 2 ELSE 4 END AS rank
FROM {entity} e, {term} WHERE contains(lower(id), needle) OR contains(lower(label), needle)
UNION ALL
SELECT needle, e.*, n.name, CASE WHEN lower(n.name) = needle THEN 1 WHEN starts_with(lower(n.name), needle) THEN 3 ELSE 5 END
FROM {entity} e JOIN (SELECT 'chip' AS kind, chip_id AS id, name FROM {chip_name} UNION ALL SELECT 'system', system_id, name FROM {system_name}) n USING (kind, id), {term} WHERE contains(lower(n.name), needle)"""
SQL["sea1_global_search"] = """
WITH best AS (SELECT * FROM {hit} QUALIFY row_number() OVER (PARTITION BY needle, kind, id ORDER BY rank, matched_on NULLS FIRST) = 1),
capped AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY needle, kind ORDER BY rank, length(label), label, id) <= 5),
placed AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY rank, kr DESC, length(label), label, id) AS position FROM capped)
SELECT needle, position, kind, id, label, detail, matched_on, rank FROM placed WHERE position <= 20"""
SQL["sea2_resolve_alias"] = """
WITH ct AS (SELECT upper(chip_id) AS term FROM {chip} UNION SELECT upper(name) FROM {chip_name} UNION SELECT chip_id FROM {chip}),
     st AS (SELECT upper(name) AS term FROM {system_name} UNION SELECT upper(system_id) FROM {system}),
     m AS (SELECT 'chip' AS kind, term, chip_id AS id, CASE WHEN chip_id = term THEN 0 ELSE 1 END AS how FROM ct JOIN {chip} ON lower(chip_id) = lower(term)
           UNION ALL SELECT 'chip', term, chip_id, 2 FROM ct JOIN {chip_name} ON lower(name) = lower(term)
           UNION ALL SELECT 'system', term, system_id, CASE WHEN system_id = term THEN 0 ELSE 1 END FROM st JOIN {system} ON lower(system_id) = lower(term)
           UNION ALL SELECT 'system', term, system_id, 2 FROM st JOIN {system_name} ON lower(name) = lower(term))
SELECT kind, term, id FROM m QUALIFY row_number() OVER (PARTITION BY kind, term ORDER BY how, id) = 1"""
EXTRA["best"] = "SELECT chip_id, best_via, provider_chip_id FROM {v_chip_evidence} WHERE kind_id = 'fpga_hdl'"
EXTRA["chip_list"] = """
SELECT c.chip_id, c.display_name, c.function_id, f.label AS function_label, f.prospector_band, c.manufacturer_id, m.name AS manufacturer_name, c.year_introduced,
  coalesce(ic.implementation_count, 0) AS fpga_implementations, coalesce(b.n, 0) AS machine_count, coalesce(s.n, 0) AS system_count, e.best_via
FROM {chip} c JOIN {chip_function} f USING (function_id) LEFT JOIN {manufacturer} m ON m.manufacturer_id = c.manufacturer_id
LEFT JOIN {v_chip_implementation_count} ic ON ic.chip_id = c.chip_id AND ic.kind_id = 'fpga_hdl'
LEFT JOIN (SELECT chip_id, count(DISTINCT machine_id) AS n FROM {v_machine_bom} GROUP BY 1) b ON b.chip_id = c.chip_id
LEFT JOIN (SELECT chip_id, count(DISTINCT system_id) AS n FROM {v_system_chip_effective} GROUP BY 1) s ON s.chip_id = c.chip_id LEFT JOIN {best} e ON e.chip_id = c.chip_id"""
SQL["brw1_chip_browser"] = "SELECT * FROM {chip_list}"
SQL["brw2_chip_filter_sort"] = """SELECT * FROM {chip_list} WHERE best_via IN ('equivalent', 'provides') AND (display_name ILIKE '%r%' OR chip_id ILIKE '%r%')"""
EXTRA["machine_list"] = """
SELECT m.machine_id, m.name, m.year, m.manufacturer_id, m.system_id, m.driver_status, coalesce(c.t, 0) AS chips_total, coalesce(c.s, 0) AS chips_satisfied, coalesce(u.n, 0) AS unmapped_devices,
  CAST(m.machine_id IN (SELECT machine_id FROM {implementation_machine}) OR coalesce(m.system_id IN (SELECT system_id FROM {implementation_system}), false) AS INTEGER) AS has_core
FROM {v_machine} m LEFT JOIN (SELECT machine_id, count(DISTINCT b.chip_id) AS t, count(DISTINCT e.chip_id) AS s FROM {v_machine_bom} b LEFT JOIN {best} e USING (chip_id) GROUP BY 1) c USING (machine_id)
LEFT JOIN (SELECT machine_id, count(DISTINCT mame_device) AS n FROM {machine_unmapped_device} GROUP BY 1) u USING (machine_id)"""
SQL["brw3_machine_browser"] = "SELECT * FROM {machine_list}"
SQL["brw4_machine_filter_sort"] = """
SELECT * FROM {machine_list} WHERE system_id IN (SELECT system_id FROM {system} WHERE kind_id = 'console') AND year BETWEEN 1994 AND 1999 AND has_core = 0 AND name ILIKE '%board%'
  AND chips_total > 0 AND 100 * chips_satisfied >= 50 * chips_total"""
EXTRA["cov"] = "SELECT * EXCLUDE (kind_id) FROM {v_system_coverage_by_kind} WHERE kind_id = 'fpga_hdl'"
EXTRA["member"] = "SELECT system_id, count(*) AS n FROM {v_machine_system} WHERE system_id IS NOT NULL GROUP BY 1"
EXTRA["system_list"] = """
SELECT s.system_id, s.name, s.kind_id, k.label AS kind_label, s.manufacturer_id, m.name AS manufacturer_name, s.year_introduced, s.description, c.chips_total, c.chips_satisfied,
  c.unmapped_device_count, c.confidence, coalesce(b.n, 0) AS machine_count, (SELECT count(DISTINCT implementation_id) FROM {implementation_system} i WHERE i.system_id = s.system_id) AS core_count
FROM {system} s JOIN {system_kind} k ON k.kind_id = s.kind_id LEFT JOIN {manufacturer} m ON m.manufacturer_id = s.manufacturer_id JOIN {cov} c ON c.system_id = s.system_id LEFT JOIN {member} b ON b.system_id = s.system_id"""
SQL["brw5_system_browser"] = "SELECT * FROM {system_list}"
SQL["brw5_system_filter"] = "SELECT * FROM {system_list} WHERE kind_id = 'console' AND core_count = 0 AND (name ILIKE '%family%' OR system_id ILIKE '%family%')"
EXTRA["impl_list"] = """
SELECT i.implementation_id, i.name, i.repo_url, i.license_id, l.name AS license_name, l.is_osi_approved, i.accuracy_id, a.label AS accuracy_label, i.hdl_language_id, h.label AS language_label,
  i.project_id, p.name AS project_name, p.author, i.verified_against_hardware, i.last_reviewed, i.resource_notes, i.notes,
  (SELECT count(*) FROM {implementation_chip} x WHERE x.implementation_id = i.implementation_id) AS chip_count,
  (SELECT count(*) FROM {implementation_machine} x WHERE x.implementation_id = i.implementation_id) AS machine_count,
  (SELECT count(*) FROM {implementation_system} x WHERE x.implementation_id = i.implementation_id) AS system_count,
  (SELECT count(*) FROM {implementation_dependency} x WHERE x.provider_id = i.implementation_id) AS consumer_count
FROM {implementation} i LEFT JOIN {license} l ON l.license_id = i.license_id LEFT JOIN {accuracy_level} a ON a.accuracy_id = i.accuracy_id
LEFT JOIN {hdl_language} h ON h.language_id = i.hdl_language_id LEFT JOIN {project} p ON p.project_id = i.project_id"""
SQL["brw6_implementation_browser"] = "SELECT * FROM {impl_list}"
SQL["brw6_implementation_filter"] = """
SELECT * FROM {impl_list} WHERE license_id IS NULL AND implementation_id IN (SELECT implementation_id FROM {implementation_platform} WHERE platform_id = 'america')
  AND concat_ws(chr(10), name, implementation_id, author, project_name) ILIKE '%author%'"""
SQL["brw7_prospector_filters"] = """
SELECT platform_id, rank, system_id, score FROM {prospect_rank} WHERE platform_id = 'asia' AND system_kind_id = 'console' AND (system_name ILIKE '%family%' OR system_id ILIKE '%family%')"""
SQL["brw8_facets"] = """
SELECT DISTINCT 'chip_function' AS facet, function_id AS value, label FROM {chip} JOIN {chip_function} USING (function_id)
UNION ALL SELECT DISTINCT 'chip_manufacturer', c.manufacturer_id, m.name FROM {chip} c JOIN {manufacturer} m USING (manufacturer_id)
UNION ALL SELECT DISTINCT 'license', license_id, license_id FROM {implementation} WHERE license_id IS NOT NULL
UNION ALL SELECT DISTINCT 'project', project_id, p.name || coalesce(' — ' || p.author, '') FROM {implementation} JOIN {project} p USING (project_id)
UNION ALL SELECT DISTINCT 'system_kind', kind_id, label FROM {system} JOIN {system_kind} USING (kind_id)"""
SQL["det1_chip_head"] = """
SELECT c.chip_id, c.display_name, c.function_id, f.label AS function_label, f.description AS function_description, f.prospector_band, c.manufacturer_id, m.name AS manufacturer_name, c.family_id,
  y.name AS family_name, c.model, c.description, c.typical_clock_hz, c.package, c.year_introduced, c.notes
FROM {chip} c JOIN {chip_function} f USING (function_id) LEFT JOIN {manufacturer} m ON m.manufacturer_id = c.manufacturer_id LEFT JOIN {chip_family} y ON y.family_id = c.family_id"""
SQL["det1_chip_implementations"] = """
SELECT DISTINCT s.socket_chip_id AS chip_id, i.implementation_id, i.name, i.kind_id, i.repo_url, i.license_id, l.license_name, i.accuracy_id, l.accuracy_label, l.language_label, i.project_id, l.project_name,
  l.author, i.verified_against_hardware, i.last_reviewed, s.via, s.provider_chip_id
FROM {v_chip_satisfies} s JOIN {implementation_chip} c ON c.chip_id = s.provider_chip_id JOIN {implementation} i USING (implementation_id) JOIN {impl_list} l USING (implementation_id)"""
SQL["det1_chip_machines"] = """
SELECT b.chip_id, b.machine_id, m.name, m.year, m.system_id, b.role, b.via, b.clock_hz, b.quantity FROM {v_machine_bom} b JOIN {v_machine} m USING (machine_id)"""
SQL["det1_chip_equivalences"] = """
SELECT k.chip_id, e.from_chip_id, e.to_chip_id, e.kind, e.note, f.display_name AS from_name, t.display_name AS to_name
FROM {chip_equivalence} e JOIN {chip} f ON f.chip_id = e.from_chip_id JOIN {chip} t ON t.chip_id = e.to_chip_id JOIN {chip} k ON k.chip_id IN (e.from_chip_id, e.to_chip_id)"""
SQL["det1_chip_systems"] = "SELECT chip_id, system_id, name, via FROM {v_system_chip_effective} JOIN {system} USING (system_id)"
SQL["det1_chip_machine_count"] = "SELECT chip_id, count(DISTINCT machine_id) AS machine_count FROM {v_machine_bom} GROUP BY 1"
SQL["det2_machine_head"] = """
SELECT m.machine_id, m.name, m.year, f.name AS manufacturer_name, m.system_id, s.name AS system_name, m.mame_sourcefile, m.driver_status, m.clone_count, c.reason AS correction_reason,
  c.source_url AS correction_source, o.reason AS system_reason FROM {v_machine} m LEFT JOIN {manufacturer} f ON f.manufacturer_id = m.manufacturer_id LEFT JOIN {system} s ON s.system_id = m.system_id
LEFT JOIN {machine_correction} c ON c.machine_id = m.machine_id LEFT JOIN {machine_system} o ON o.machine_id = m.machine_id"""
SQL["det2_machine_bom_detail"] = """
SELECT b.machine_id, b.chip_id, b.role, b.quantity, b.clock_hz, b.via, c.display_name, f.label AS function_label, f.prospector_band, e.best_via, e.provider_chip_id
FROM {v_machine_bom} b JOIN {chip} c USING (chip_id) JOIN {chip_function} f USING (function_id) LEFT JOIN {best} e ON e.chip_id = b.chip_id"""
SQL["det2_machine_implementations"] = """
SELECT b.machine_id, b.chip_id, i.implementation_id, i.name, i.repo_url, s.via FROM (SELECT DISTINCT machine_id, chip_id FROM {v_machine_bom}) b JOIN {v_chip_satisfies} s ON s.socket_chip_id = b.chip_id
JOIN {implementation_chip} c ON c.chip_id = s.provider_chip_id JOIN {implementation} i USING (implementation_id) WHERE i.kind_id = 'fpga_hdl'"""
SQL["det2_machine_cores"] = """
WITH c AS (SELECT machine_id, implementation_id, 'machine' AS scope FROM {implementation_machine} UNION ALL
           SELECT machine_id, implementation_id, 'system' FROM {v_machine_system} JOIN {implementation_system} USING (system_id))
SELECT c.machine_id, implementation_id, i.name, i.repo_url, i.license_id, i.accuracy_id, min(scope) AS scope FROM c JOIN {implementation} i USING (implementation_id) GROUP BY ALL"""
SQL["det2_machine_unmapped"] = "SELECT machine_id, mame_device, quantity FROM {machine_unmapped_device}"
SQL["det3_system_head"] = """
SELECT s.system_id, s.name, k.label AS kind_label, m.name AS manufacturer_name, s.year_introduced, s.description, s.notes, c.chips_total, c.chips_satisfied, c.chips_direct, c.chips_equivalent,
  c.chips_provided, c.satisfied_share, c.unmapped_device_count, c.confidence, coalesce(b.n, 0) AS machine_count, i.unmapped_share AS unmapped_instance_share
FROM {system} s JOIN {system_kind} k ON k.kind_id = s.kind_id LEFT JOIN {manufacturer} m ON m.manufacturer_id = s.manufacturer_id JOIN {cov} c ON c.system_id = s.system_id
LEFT JOIN {member} b ON b.system_id = s.system_id LEFT JOIN {v_system_instance} i ON i.system_id = s.system_id"""
SQL["det3_system_chipset"] = """
SELECT e.system_id, e.chip_id, e.via, c.display_name, f.label AS function_label, f.prospector_band, v.satisfied_via, v.provider_chip_id, v.chip_confidence, coalesce(u.n, 0) AS machine_count
FROM {v_system_chip_effective} e JOIN {chip} c USING (chip_id) JOIN {chip_function} f USING (function_id)
LEFT JOIN {v_system_chip_coverage} v ON v.kind_id = 'fpga_hdl' AND v.system_id = e.system_id AND v.chip_id = e.chip_id
LEFT JOIN (SELECT system_id, chip_id, count(DISTINCT machine_id) AS n FROM {machine_chip} JOIN {v_machine_system} USING (machine_id) GROUP BY ALL) u ON u.system_id = e.system_id AND u.chip_id = e.chip_id"""
SQL["det3_system_platforms"] = """
SELECT s.system_id, p.platform_id, p.label, CAST(EXISTS (SELECT 1 FROM {v_system_core} f WHERE f.kind_id = 'fpga_hdl' AND f.system_id = s.system_id AND f.platform_id = p.platform_id) AS INTEGER) AS has_core
FROM {system} s, {fpga_platform} p"""
SQL["det3_system_machines"] = """
SELECT system_id, machine_id, name FROM {v_machine} WHERE system_id IS NOT NULL"""
SQL["det3_system_drivers"] = "SELECT system_id, mame_sourcefile FROM {system_driver}"
SQL["det3_system_cores"] = "SELECT system_id, implementation_id, name, repo_url, license_id FROM {implementation_system} JOIN {implementation} USING (implementation_id)"
SQL["det4_implementation_links"] = """
SELECT x.implementation_id, 'chip' AS relation, c.chip_id AS id, c.display_name AS name, CAST(NULL AS VARCHAR) AS note FROM {implementation_chip} x JOIN {chip} c USING (chip_id)
UNION ALL SELECT x.implementation_id, 'system', s.system_id, s.name, NULL FROM {implementation_system} x JOIN {system} s USING (system_id)
UNION ALL SELECT * FROM (SELECT x.implementation_id, 'machine', m.machine_id, m.name, NULL FROM {implementation_machine} x JOIN {v_machine} m USING (machine_id))
UNION ALL SELECT d.consumer_id, 'provider', d.provider_id, i.name, d.note FROM {implementation_dependency} d JOIN {implementation} i ON i.implementation_id = d.provider_id
UNION ALL SELECT d.provider_id, 'consumer', d.consumer_id, i.name, NULL FROM {implementation_dependency} d JOIN {implementation} i ON i.implementation_id = d.consumer_id"""
SQL["dsh1_headline"] = """
SELECT (SELECT count(*) FROM {chip}) AS chips, (SELECT count(*) FROM {machine}) AS machines, (SELECT count(*) FROM {system}) AS systems,
  (SELECT count(*) FROM {implementation} WHERE kind_id = 'fpga_hdl') AS implementations, (SELECT count(*) FROM {project}) AS projects, (SELECT count(*) FROM {best}) AS chips_covered,
  (SELECT count(*) FROM {best} WHERE best_via = 'self') AS chips_direct, (SELECT count(DISTINCT machine_id) FROM {implementation_machine}) AS machines_with_core,
  (SELECT count(DISTINCT system_id) FROM {implementation_system}) AS systems_with_core, (SELECT count(*) FROM {v_prospector} WHERE platform_id = 'asia') AS prospector_candidates"""
SQL["dsh2_band_rollup"] = """
SELECT prospector_band AS band, count(*) AS chips, count(e.chip_id) AS covered FROM {chip} c JOIN {chip_function} USING (function_id) LEFT JOIN {best} e ON e.chip_id = c.chip_id GROUP BY 1"""
SQL["dsh3_top_worklist"] = "SELECT mame_device, machine_count, instance_count FROM {v_mame_device_worklist} ORDER BY instance_count DESC, machine_count DESC, mame_device LIMIT 8"

# -- row lints ------------------------------------------------------------------------------------------
EXTRA["key_finding"] = """
SELECT 'ERROR' AS severity, 'data/chip/' || upper(chip_id) || '.json' AS file, 'chip' AS "table", chip_id AS key, 'chip_id' AS "column", 'filename-key' AS rule FROM {chip} WHERE function_id = 'glue'
UNION ALL SELECT 'ERROR', 'data/chip/p0.json', 'chip_name', chip_id || '/' || name, 'chip_id', 'filename-key' FROM {chip_name} WHERE kind = 'retired_id' AND chip_id <> 'p0'
  AND (SELECT function_id FROM {chip} WHERE chip_id = 'p0') <> 'glue'"""
SQL["val1_filename_key"] = "SELECT * FROM {key_finding}"
SQL["val2_row_order"] = """
SELECT 'data/mame_device.json' AS file, 'mame_device' AS "table", arg_min(mame_device, n) AS key, 'row-order' AS rule
FROM (SELECT mame_device, n, lag(mame_device) OVER (ORDER BY n) AS above, lag(n) OVER (ORDER BY n) AS an FROM (SELECT mame_device, CAST(substr(mame_device, 2) AS BIGINT) AS n FROM {mame_device}))
WHERE mame_device < above AND an = n - 1 HAVING count(*) > 0"""
SQL["val3_clock_range"] = """
SELECT 'chip' AS "table", chip_id AS key, 'typical_clock_hz' AS "column", 'clock-range' AS rule, 'typical_clock_hz is ' || typical_clock_hz * 300 || ' Hz, outside 1000..1000000000' AS message
FROM {chip} WHERE typical_clock_hz * 300 NOT BETWEEN 1000 AND 1000000000"""
SQL["val4_year_range"] = """
SELECT 'chip' AS "table", chip_id AS key, 'year_introduced' AS "column", 'year-range' AS rule, 'year_introduced is ' || year_introduced || ', outside 1970..2005' AS message
FROM {chip} WHERE year_introduced NOT BETWEEN 1970 AND 2005"""
_TARGET = {"CHIP_MANUFACTURER_FAMILY_MISMATCH": ("chip", "manufacturer_id"), "CHIP_NAME_COLLISION": ("chip", "display_name"), "SYSTEM_NAME_COLLISION": ("system", "name"),
           "MAPPED_INSTANCE_SHARE_LOW": ("", ""), "UNMAPPED_DEVICE_HIGH_IMPACT": ("mame_device", "chip_id"), "CHIP_MISSING_METADATA": ("chip", "manufacturer_id, description"),
           "IMPL_UNVERIFIED_LICENSE": ("implementation", "license_id"), "IMPL_UNVERIFIED_ACCURACY": ("implementation", "accuracy_id"), "IMPL_STALE_REVIEW": ("implementation", "last_reviewed"),
           "IMPL_UNTARGETED": ("implementation", ""), "IMPL_MACHINES_WITHOUT_SYSTEM": ("implementation", ""), "SYSTEM_NO_CHIPS": ("system", ""), "SYSTEM_UNMAPPED_SHARE_HIGH": ("system", ""),
           "MACHINE_ZERO_MAPPED_CHIPS": ("machine", ""), "EQUIVALENCE_MUTUAL_PROVIDES": ("chip_equivalence", "kind")}
SQL["val5_warning_diagnostic"] = f"""
SELECT 'WARN' AS severity, CASE WHEN t = 'chip' THEN 'data/chip/' || subject || '.json' ELSE '(database)' END AS file, t AS "table", coalesce(subject, '') AS key, c AS "column",
  lower(replace(code, '_', '-')) AS rule FROM {{v_quality_warning}} JOIN (VALUES {', '.join(f"('{k}', '{a}', '{b}')" for k, (a, b) in _TARGET.items())}) AS v(code, t, c) USING (code)"""
SQL["val6_sort_and_count"] = """
SELECT (SELECT count(*) FROM {key_finding}) AS errors, (SELECT count(*) FROM {chip} WHERE year_introduced NOT BETWEEN 1970 AND 2005) AS warnings,
  CAST((SELECT count(*) FROM {key_finding}) > 0 AS INTEGER) AS failed"""

ORACLE = {name: build(sql, EXTRA) for name, sql in SQL.items()}
