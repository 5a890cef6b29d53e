"""Training-data operators: quality, tokens, PII, HTML, toxicity, mixing, packing, search, dedup.

Each module holds one operator with a general interface; ``queries`` registers
the thin ``opN_<name>`` queries over the driver's tables. Nothing outside this
package imports it.
"""
