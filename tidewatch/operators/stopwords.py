"""Default English stop words for topic labels; callers may pass their own list."""

# Common English function words.
STOP_WORDS = """
a about above after again against all also am an and any are as at be because been before being
below between both but by can cannot could did do does doing down during each either else ever
every few for from further get had has have having he her here hers herself him himself his how
however if in into is it its itself just least less many me might more most much must my myself
neither no nor not of off often on once only or other our ours ourselves out over own per perhaps
rather same she should since so some still such than that the their theirs them themselves then
there these they this those though through to too toward under until up upon us very was we were
what when where whether which while who whom whose why will with within without would yet you your
yours yourself yourselves
""".split()
