"""poolsift: pool selection and run analytics as Spark DataFrame functions.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame ->
DataFrame operators), ``sources`` (readers and sinks), ``streaming``
(Structured Streaming jobs), ``plans`` (registered queries over the supplied
tables and their SQL oracles).  Start a session with
``poolsift.session.get_session`` or call ``poolsift.session.prepare`` on an
existing one.
"""

__version__ = "0.1.0"
