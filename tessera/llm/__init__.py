"""Training-data operators: search, dedup, mixing, language, toxicity, tokens, chat.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only
when it is present.
"""
