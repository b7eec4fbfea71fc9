"""Digests of the canonical forms of long licence texts, whole and without what follows their terms; see ``license.canonical``."""

# Fixed values.
DIGESTS = {
    "Apache-2.0": (
        "4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5",
        "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809",
        "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93",
    ),
    "Artistic-1.0-Perl": (
        "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    ),
    "CC0-1.0": (
        "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    ),
    "GFDL-1.2": (
        "0d85992b194c7a8f42f3c09cd4f2fce26c85b84312da877a95f283fc01be659e",
        "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",
        "8d636e2e2f248f9b102e9d9f78337901ec8bca3bfe91434cdcf261a01bf305b1",
    ),
    "GFDL-1.3": (
        "59654aeac1342c4c089f14cf55f567a683bbc21b4b3ce81b6b855cd9b20ee944",
        "8b8b57bd195ed50d50edb5da1dd173b409fb9b075910c69726be7d0363c40008",
        "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",
    ),
    "GPL-1.0": (
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    ),
    "GPL-2.0": (
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    ),
    "GPL-3.0": (
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
        "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
    ),
    "LGPL-2.0": (
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    ),
    "LGPL-2.1": (
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1",
    ),
    "MPL-2.0": (
        "4544af666fc42fe3ea03e86d5db9fef4f4c41c50c15f04550119fdb67822747b",
    ),
}
