"""Parse checks of source text: lexer-state maps, bracket summaries and local grammars over token classes."""
