"""The registered queries of this subpackage and their SQL."""

from pathloom.llm import decontaminate, language_id, license_scan, line_dedup, near_dedup, packing, quality_classifier, quality_rules, secret_scan, surrogates

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_minhash_near_dedup": near_dedup.op4_minhash_near_dedup,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_pii_surrogates": surrogates.op7_pii_surrogates,
    "op8_packing": packing.op8_packing,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

#: Those that SQL can't express are held against brute force in the tests.
ORACLES = {
    "op2_secret_scan": secret_scan.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op9_license_scan": license_scan.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
}
