from faultline.functions.text import (  # noqa: F401
    BAD_OUTPUT_LIMIT, FAIL_THRESHOLD, FAULT_DOC, FAULT_TRIGRAM, HEAVY_WEIGHT,
    LIGHT_WEIGHT, NAME_SEPARATOR, TOKEN_SPLIT_PATTERN, TRIGRAM_SEPARATOR, WATCH_LIMIT,
    contents_of, doc_of, fault_weight, has_name, output_id, tokens_of, trigram_of, trigram_parts,
)
