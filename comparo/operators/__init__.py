"""DataFrame -> DataFrame operators. None of them collects data to the
driver except the bounded size probes in ``joins`` and the one-row NULL
census of ``filters.drop_null_columns``."""
