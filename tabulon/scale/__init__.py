"""Building blocks that keep the operators safe at cluster scale.

``storage``  shared scratch folder used to cut lineage
``ordering`` distributed row index and segmented running totals / carry-forward
``skew``     hot-key detection and salted joins
``counts``   rank and quantile positions from per-value counts
"""
