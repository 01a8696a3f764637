"""DataFrame -> DataFrame operators: ordering primitives, layout, missing data,
imputation, transforms, diagnostics, linear models, causality, learned models
and result shaping."""
