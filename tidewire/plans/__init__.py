def load_all():
    """Import every query module and return the registry."""
    import importlib

    from . import catalog
    for name in ("message_queries", "report_queries", "evaluation_queries", "pdu_queries",
                 "model_queries", "table_queries", "stream_queries"):
        try:
            importlib.import_module(f"{__name__}.{name}")
        except ModuleNotFoundError as e:
            if not str(e.name).endswith(name):
                raise
    return catalog
