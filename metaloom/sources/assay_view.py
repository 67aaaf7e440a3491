"""The star schema seen as a relational assay database: the tables that bioactivity sources share.

Parts are molecules, suppliers targets, orders assays and documents, line items activities. Some structures,
components, sequences and documents are absent, so that outer joins have something to keep.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .graph_view import load


@dataclass
class Assays:
    molecules: DataFrame  # molregno, compound, max_phase, name, withdrawn, black_box, therapeutic
    structures: DataFrame  # molregno, smiles, inchikey
    targets: DataFrame  # tid, target, target_name, target_type, tax_id
    components: DataFrame  # tid, component_id
    sequences: DataFrame  # component_id, accession
    assays: DataFrame  # assay_id, tid, doc_id, description, assay_type, assay
    activities: DataFrame  # activity_id, assay_id, molregno, standard_type, standard_value, standard_units, standard_relation, pchembl_value, comment
    documents: DataFrame  # doc_id, year, pubmed_id
    mechanisms: DataFrame  # ordinal, molregno, tid, action_type
    indications: DataFrame  # drugind_id, molregno, mesh_id, efo_id, max_phase_for_ind
    references: DataFrame  # drugind_id, ref_type, ref_id
    classes: DataFrame  # molregno, level5


#: Each table as one SQL query over the star schema, for the reader below and for the oracles alike.
TABLES = {
    "molecules": "SELECT p_partkey AS molregno, concat('M', p_partkey) AS compound, CASE WHEN p_size % 6 < 5 THEN p_size % 6 END AS max_phase, CASE WHEN p_size % 4 > 0 THEN p_name END AS name, p_size % 10 = 0 AS withdrawn, p_size % 9 = 0 AS black_box, p_size % 2 = 0 AS therapeutic FROM part",
    "structures": "SELECT p_partkey AS molregno, p_type AS smiles, concat(p_brand, '-', p_partkey) AS inchikey FROM part WHERE p_size % 7 <> 0",
    "targets": "SELECT s_suppkey AS tid, concat('T', s_suppkey) AS target, s_name AS target_name, CASE WHEN s_suppkey % 3 = 0 THEN 'ORGANISM' ELSE 'SINGLE PROTEIN' END AS target_type, s_nationkey % 5 AS tax_id FROM supplier",
    "components": "SELECT s_suppkey AS tid, s_suppkey + 7 AS component_id FROM supplier WHERE s_suppkey % 5 <> 0",
    "sequences": "SELECT s_suppkey + 7 AS component_id, concat('A', s_suppkey) AS accession FROM supplier WHERE s_suppkey % 11 <> 0",
    "assays": "SELECT o_orderkey AS assay_id, o_custkey % 10 + 1 AS tid, o_orderkey % 500 AS doc_id, o_orderpriority AS description, o_orderstatus AS assay_type, concat('X', o_orderkey) AS assay FROM orders",
    "activities": "SELECT l_orderkey * 8 + l_linenumber AS activity_id, l_orderkey AS assay_id, l_partkey AS molregno, CASE l_linenumber % 4 WHEN 0 THEN 'IC50' WHEN 1 THEN 'EC50' WHEN 2 THEN 'Ki' ELSE 'Potency' END AS standard_type, CASE WHEN l_quantity > 3 THEN l_extendedprice END AS standard_value, 'nM' AS standard_units, CASE WHEN l_returnflag = 'R' THEN '>' ELSE '=' END AS standard_relation, l_discount * 100 AS pchembl_value, l_linestatus AS comment FROM lineitem",
    "documents": "SELECT DISTINCT o_orderkey % 500 AS doc_id, 1990 + o_orderkey % 500 % 30 AS year, o_orderkey % 500 + 100000 AS pubmed_id FROM orders WHERE o_orderkey % 500 % 13 <> 0",
    "mechanisms": "SELECT s_suppkey * 1000 + p_size AS ordinal, p_partkey AS molregno, s_suppkey AS tid, CASE WHEN p_size % 3 > 0 THEN concat('ACTION', p_size % 3) END AS action_type FROM part JOIN supplier ON s_suppkey = p_partkey % 10 + 1",
    "indications": "SELECT p_partkey AS drugind_id, p_partkey AS molregno, concat('D', p_size % 8) AS mesh_id, concat('E', p_size % 12) AS efo_id, p_size % 5 AS max_phase_for_ind FROM part",
    "references": "SELECT p_partkey AS drugind_id, CASE WHEN p_size % 2 = 0 THEN 'ClinicalTrials' ELSE 'Label' END AS ref_type, concat('N', p_partkey) AS ref_id FROM part WHERE p_size % 3 <> 1",
    "classes": "SELECT p_partkey AS molregno, concat('ATC', p_size % 4) AS level5 FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, concat('ATC', p_size % 7 + 4) FROM part WHERE p_size > 30",
}
ASSAYS_SQL = ", ".join(f'"{k}" AS ({v})' if k == "references" else f"{k} AS ({v})" for k, v in TABLES.items())
_READS = ("part", "supplier", "orders", "lineitem")


def assays(spark: SparkSession, sf_dir: str) -> Assays:
    tables = {t: load(spark, sf_dir, t) for t in _READS}

    def table(text: str) -> DataFrame:
        used = {t: df for t, df in tables.items() if f" {t}" in text}
        for t, df in used.items():
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        return spark.sql(text, **used)

    return Assays(**{k: table(v) for k, v in TABLES.items()})
