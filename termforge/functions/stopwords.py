"""Stop words of the two analysers."""

# These lists decide which tokens are kept, so they are stated word by word.
ENGLISH = (
    "a an the and or not is are was were be been have has had do does did will would could should may "
    "to of in for on with at by from as it its this that i you he she we they me him her us them my your his our their"
).split()
RUSSIAN = (
    "и в во не что он на я с как а то она так его но да ты к у же вы за бы по только ее от это о из ему когда или ни быть "
    "был до вас уже там где для мы их чем была без раз тоже под будет кто этот при об про всё нас"
).split()


def stop_words(lang: str) -> list[str]:
    """The Russian list for Russian, the English one for every other language name."""
    return RUSSIAN if lang == "russian" else ENGLISH
