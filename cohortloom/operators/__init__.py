"""DataFrame-to-DataFrame operators; each returns a lazy plan unless its docstring says otherwise."""
