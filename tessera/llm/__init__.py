"""Training-data operators: ten batch operators over documents, embeddings and conversations.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; the thin queries that apply them to whole tables are in
:mod:`tessera.llm.queries`.
"""
