"""Operations of a training-data pipeline: one module for each operator, one for their registered queries."""
