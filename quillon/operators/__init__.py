"""DataFrame operators: stylometry, lexicon scoring, evaluation, curation, layout."""
